"""Panel-data analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions travel to executors whole, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
