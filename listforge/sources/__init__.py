"""listforge.sources."""
