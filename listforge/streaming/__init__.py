"""listforge.streaming."""
