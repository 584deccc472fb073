"""streaming of docloom."""
