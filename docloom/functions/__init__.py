"""Functions on text, geometry and identifiers: Column expressions where Spark has the means, plain Python for kernels."""
