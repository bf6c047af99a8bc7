"""driftwatch: data-integrity and drift operators as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python workers receive our functions by value, so executors need not have
# this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
