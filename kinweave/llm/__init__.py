"""Operators for preparing training text; nothing outside this package imports it.

Functions that run in tasks travel by value, so executors need only PySpark and the
listed libraries, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
