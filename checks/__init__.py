"""Queries over the test tables, each with its SQL twin where SQL can express it."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
