"""Op-log analytics on Spark DataFrames.

Functions of the package that run on executors are pickled by value, so it needn't be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
