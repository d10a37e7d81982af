"""functions of keyloom."""
