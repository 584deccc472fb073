"""functions of docloom."""
