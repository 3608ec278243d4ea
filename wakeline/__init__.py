"""Maritime incident analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Task functions travel by value, so executors need numpy, pandas and pyspark but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
