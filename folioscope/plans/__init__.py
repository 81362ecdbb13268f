"""Part of the engine: plans."""
