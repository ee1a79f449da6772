"""Sources, pixel kernels and interfaces to outside services."""
