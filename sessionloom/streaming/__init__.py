"""streaming of the transcript corpus engine."""
