"""Graphs, materialised cubes, datasets, failures as data."""
