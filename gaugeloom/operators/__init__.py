"""Operators on station, segment, raster, graph and prediction tables."""
