"""Curation and evaluation jobs over recorded model traffic, as plain PySpark functions."""

import sys

from pyspark import cloudpickle

# Pandas functions travel to executors by value, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
