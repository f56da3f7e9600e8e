"""Query text, routing, placement and the engine."""
