"""Stagehand: a PySpark-native engine for listings, documents and search."""

import sys

from pyspark import cloudpickle

# Functions run by Python workers travel with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
