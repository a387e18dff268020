"""revforge package."""
