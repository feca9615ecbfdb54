"""Spark-native analytics over file catalogs: tables that describe every file of a set of drives."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from pathledger.operators.search import search, search_files  # noqa: E402

__all__ = ["search", "search_files"]
