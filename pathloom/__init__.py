"""Path search, ranking and corpus preparation as PySpark DataFrame operators.

Functions of this package that run inside Python workers are shipped by value, so executors
need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
