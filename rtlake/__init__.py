"""A Spark-native index and query engine for trees of hardware-description source text."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
