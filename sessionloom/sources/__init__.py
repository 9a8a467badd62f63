"""sources of the transcript corpus engine."""
