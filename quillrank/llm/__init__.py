"""Operators of a training-data pipeline; nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the Python workers by value, so workers need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
