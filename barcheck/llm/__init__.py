"""Operators for training-data pipelines: one module per operator, their queries in ``queries``."""

import sys

from pyspark import cloudpickle

#: Functions of this package travel to the Python workers by value, so it need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
