"""polyquill: poly(A)-tail composition analytics as lazy PySpark DataFrame transformations."""

from pyspark import cloudpickle as _cloudpickle

import polyquill as _self

# Functions handed to executors travel by value, so workers need no copy of the package on their path.
_cloudpickle.register_pickle_by_value(_self)
