"""Column helpers (exprs) and distributed ranks, running sums and exact
quantiles that never hold a hot group in one task (ranking)."""
