"""cohortlens.sources."""
