"""Functions that executors run carry this package with them, so a job starts from any folder."""

from __future__ import annotations

from pyspark import cloudpickle

import liftline


def ship() -> None:
    """Pickle this package's functions by value: executors need not find it on their path."""
    cloudpickle.register_pickle_by_value(liftline)
