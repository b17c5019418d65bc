"""Spark-first engine for raw disk images, recovered files and text corpora.

Functions of this package are sent to executors by value, so a cluster needs
the package on the driver alone.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
