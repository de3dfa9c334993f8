"""Repair and analysis of categorical labels on points and masks, built on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
