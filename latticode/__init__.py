"""Compressed vector tables and document retrieval as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so the package
# has to be installed only where the driver runs.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
