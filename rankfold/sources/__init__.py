"""Matrix sources: cells from tables, vectors, streams and generators."""
