"""Joins with a table of unique keys that stay even when one key holds a third of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame


def lookup(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """left (or inner) join with `right`, which has each key once.

    No job runs while the plan is built. A small right side (by the size of what is written
    or measured in a shuffle) is broadcast by the planner; else both sides are shuffled, and
    adaptive execution splits the left rows of an overfull partition over several tasks, each
    with the right rows of that partition, so a hot key isn't one task's.
    """
    return left.join(right, key, how)
