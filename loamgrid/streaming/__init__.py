"""Streams of trace tables (an extension: the batch operators on data that keeps coming)."""
