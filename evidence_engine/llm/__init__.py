"""Operators for building training data, and the queries that apply them.

Nothing else in the package imports this subpackage. Functions that run on the
executors are pickled by value, so executors need no copy of the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
