"""Samples in Spark DataFrames: summaries, quantiles, tests, distributions, densities, transforms, resampling."""
