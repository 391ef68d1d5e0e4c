"""Array kernels that run inside one task."""
