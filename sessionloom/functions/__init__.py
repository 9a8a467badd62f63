"""functions of the transcript corpus engine."""
