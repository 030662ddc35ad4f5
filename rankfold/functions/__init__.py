"""Column-level helpers: seeded hashing and ARRAY<DOUBLE> kernels."""
