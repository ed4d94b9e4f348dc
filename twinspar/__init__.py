"""twinspar: pair-similarity analytics and record linkage on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors need not have this package on their path: functions sent to them travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
