"""Extract of the engine."""
