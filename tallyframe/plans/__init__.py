"""Query text and the engine that plans it."""
