"""Spark-native analytics for continuous multi-channel biosignal recordings.

Operators take DataFrames and return DataFrames; nothing runs until the caller
asks for a result. See ``README.md`` for the layout and the scaling rules.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Python functions travel to the executors with the plan, so that workers need
# NumPy and PyArrow but not this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
