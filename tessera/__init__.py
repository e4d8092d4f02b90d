"""Spark-native document retrieval engine."""

import sys

from pyspark import cloudpickle

# Functions travel to the Python workers with the task: executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
