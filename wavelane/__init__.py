"""Spark-native operators for media-corpus curation, signal metrics and experiment evaluation."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value: executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
