"""Column expressions and array kernels over windows."""
