"""Fleet prognostics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value, so executors need no copy
# of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
