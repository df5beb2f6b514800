"""Spark-native analytics on seismic trace data and labelled grids of sampled signals."""

__version__ = "0.3.0"
