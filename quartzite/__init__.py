"""quartzite: Spark-native analytics for atomistic-simulation data."""

import sys

from pyspark import cloudpickle

# Functions shipped to executors travel by value, so workers need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
