"""Stochastic-flow graph clustering and graph-based image segmentation on PySpark DataFrames."""
