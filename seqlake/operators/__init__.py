"""seqlake.operators."""
