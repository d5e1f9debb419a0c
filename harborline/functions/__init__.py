"""Column helpers and the distributed quantile, ranking and neighbour building blocks."""
