"""recallforge package."""
