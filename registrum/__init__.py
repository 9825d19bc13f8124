"""Register analytics on Spark: line labels, segments, features and factors as DataFrame transformations."""

import sys

from pyspark import cloudpickle

from registrum.session import get_session

# Functions that run in Python workers travel whole, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["get_session"]
