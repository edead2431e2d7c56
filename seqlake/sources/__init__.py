"""seqlake.sources."""
