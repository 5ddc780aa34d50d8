"""Multi-step plans: graph traversal, versioned history, import resolution, lookups."""
