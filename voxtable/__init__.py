"""voxtable: volumetric image cytometry and corpus preparation as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions that Spark ships to Python workers travel by value, so that
# executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
