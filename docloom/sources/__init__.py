"""sources of docloom."""
