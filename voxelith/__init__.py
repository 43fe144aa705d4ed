"""Voxel-terrain analytics expressed as Spark DataFrames."""
