"""Cross-sectional factor and portfolio analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package that run inside tasks travel with the task, so workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
