"""Column expressions and vectorised kernels shared by the operators."""
