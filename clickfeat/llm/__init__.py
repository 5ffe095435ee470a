"""Operators for preparing language-model training data. Nothing else in the library imports this package.

Functions that run in Spark's Python workers are sent with their code, so the
executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
