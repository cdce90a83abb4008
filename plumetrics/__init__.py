"""plumetrics: regional greenhouse-gas analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# The small Python helpers travel with the tasks that use them; executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
