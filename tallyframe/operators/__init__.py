"""Group-by aggregation and mergeable partial state."""
