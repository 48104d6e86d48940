"""Warehouse utilities on Spark: dimensions, profiling, lineage, merges and data checks.

Every operator is a function from DataFrames and explicit parameters (the
clock included) to a DataFrame.
"""

import sys

from pyspark import cloudpickle

# functions sent to executors carry their code along, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
