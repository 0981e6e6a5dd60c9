"""Training-data operators: filtering, deduplication, scoring and mixing of text corpora."""
