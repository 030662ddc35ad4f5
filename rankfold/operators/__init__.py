"""DataFrame operators: norms, products, sketches, sampling, values, ALS, linear maps."""
