"""plans of docloom."""
