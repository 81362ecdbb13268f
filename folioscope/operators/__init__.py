"""Part of the engine: operators."""
