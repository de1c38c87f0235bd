"""Optional: keeping contract tables current from arriving snapshot files."""
