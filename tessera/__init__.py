"""Analytics over embedding vectors that are organised by sequence, frame and grid, on Spark."""
