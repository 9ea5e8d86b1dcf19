"""Plans over record tables."""
