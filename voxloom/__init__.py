"""Voxel-cloud attribute analytics and large-corpus preparation on Spark DataFrames."""
