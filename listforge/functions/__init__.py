"""listforge.functions."""
