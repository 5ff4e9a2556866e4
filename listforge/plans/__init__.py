"""listforge.plans."""
