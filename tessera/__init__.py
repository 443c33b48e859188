"""Geometry jobs on Spark tables of points, edges and faces."""
