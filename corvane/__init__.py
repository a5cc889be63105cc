"""A Spark-native engine for preference-driven document ranking and its feedback loop."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so that a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
