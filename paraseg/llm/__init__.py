"""Operators of a training-data pipeline; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Workers get the operators' functions themselves: the library need not be installed beside each executor.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
