"""dwellkit: analytics over discretised sensor recordings, as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few Python steps travel to executors by value: the package need not be
# installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
