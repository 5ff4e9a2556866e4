"""listforge.operators."""
