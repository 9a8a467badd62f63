"""plans of the transcript corpus engine."""
