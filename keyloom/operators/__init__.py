"""operators of keyloom."""
