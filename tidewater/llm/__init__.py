"""Operators of a training-data pipeline: one module per operator, queries in ``queries``.

Functions of this package that run inside Spark tasks are pickled by value, so
executors need only PySpark and the numeric libraries, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
