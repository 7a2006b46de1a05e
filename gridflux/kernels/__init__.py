"""NumPy kernels for problems that are sequential within one row or group; `gridflux.operators.batch` runs them in parallel."""
