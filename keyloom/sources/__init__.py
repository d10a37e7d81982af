"""sources of keyloom."""
