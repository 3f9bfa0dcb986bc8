"""Operators of a training-data pipeline; nothing outside this subpackage imports it.

What tasks run is sent to the executors by value, so that they need not have this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
