"""Ready-made jobs: two-pass, one-pass and the method comparison."""
