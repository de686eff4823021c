"""Spark jobs over ensembles of partially ordered graphs and their histograms."""
