"""quillrank: text retrieval, ranking and cohort building as Spark jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in Python workers travel by value, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
