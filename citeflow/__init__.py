"""Link-health analytics and text-corpus operators on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value: executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
