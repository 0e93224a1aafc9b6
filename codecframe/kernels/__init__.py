"""codecframe: kernels."""
