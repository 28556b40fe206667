"""Operators of a training-data pipeline; nothing else in the library imports them.

Functions that run in tasks are sent to the executors by value, so these need
the libraries the functions import but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
