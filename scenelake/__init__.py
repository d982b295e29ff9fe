"""A PySpark-native engine for building and querying object-detection datasets as DataFrames."""

import sys

from pyspark import cloudpickle

# functions that run on executors travel with the plan, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
