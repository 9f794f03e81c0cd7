"""DataFrame operators: codebooks, indexes, search, row order, statistics."""
