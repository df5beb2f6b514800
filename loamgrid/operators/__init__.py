"""Operators on trace tables and labelled grids."""
