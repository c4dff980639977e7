"""Operators for large-scale training-data pipelines."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to Python workers by value, so executors need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
