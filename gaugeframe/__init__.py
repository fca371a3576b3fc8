"""Inspection analytics on PySpark: grids, points, meshes, images and labelled series as DataFrames."""
