"""Operators of a training-data pipeline; nothing else in the library imports this subpackage.

The subpackage's own functions travel to the executors by value, so that a
cluster needs no copy of the library on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
