"""Operators over DataFrames: selection and batching, seeded randomness, image kernels, packing, mixing, video."""
