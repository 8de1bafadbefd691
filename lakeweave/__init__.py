"""A PySpark-native analytics engine for object lakes.

Functions of this package that run on executors travel by value, so a cluster
needs no copy of the package on its workers' path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
