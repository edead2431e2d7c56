"""seqlake.functions."""
