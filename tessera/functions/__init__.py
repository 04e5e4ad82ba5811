"""Column functions: vectors, grids, budgets and text."""
