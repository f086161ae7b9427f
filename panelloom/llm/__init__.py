"""Operators for preparing training text; nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# As in the parent package: functions sent to executors travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
