"""convoweave: a Spark-native engine for conversation archives and text corpora."""

import sys

from pyspark import cloudpickle

# Functions shipped to Python workers travel by value, so executors need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
