"""Small tables with the cases that every operator must take."""

from __future__ import annotations

CLASH = ", dk string, node string, key string, score double, _copies string"


def documents(spark, rows, more: bool = False):
    """doc_id and text, and with ``more`` columns whose names the operators use themselves."""
    if more:
        return spark.createDataFrame([(*r, "a", "b", "c", 0.5, "d") for r in rows], "doc_id long, text string" + CLASH)
    return spark.createDataFrame(rows, "doc_id long, text string")


LONG = "alpha beta gamma delta epsilon " * 4000
EDGE = [(1, None), (2, ""), (3, "x"), (3, "x"), (None, "same words here for all of us"), (4, "same words here for all of us"), (5, LONG), (6, LONG), (7, "é" * 900)]
