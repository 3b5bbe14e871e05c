"""Part of the pair-similarity engine; see the README for its contents."""
