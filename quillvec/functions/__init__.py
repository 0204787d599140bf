"""Column expressions and kernels: metrics, filters, evaluation."""
