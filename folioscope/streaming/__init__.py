"""Part of the engine: streaming."""
