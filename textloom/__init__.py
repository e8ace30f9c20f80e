"""Unicode text analytics expressed as Spark columns, joins and tables."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions for Python workers travel by value: executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
