"""operators of the transcript corpus engine."""
