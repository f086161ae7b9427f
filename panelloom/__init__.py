"""Spark-native analytics over keyed panels of dated values."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["functions", "operators", "plans", "sources"]
