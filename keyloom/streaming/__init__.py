"""streaming of keyloom."""
