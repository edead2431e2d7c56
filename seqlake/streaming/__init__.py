"""seqlake.streaming."""
