"""Point-in-time event analytics on Spark.

Every public operator is a plain function from DataFrames to DataFrames. Kernels
that run inside tasks are pickled by value, so executors need only PySpark,
numpy and pandas.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
