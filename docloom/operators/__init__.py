"""operators of docloom."""
