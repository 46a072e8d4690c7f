"""Training-data operators; their queries and oracle SQL are in :mod:`itemlake.llm.registry`."""
