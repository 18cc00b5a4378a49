"""Column-returning functions and the few Arrow-batched helpers."""
