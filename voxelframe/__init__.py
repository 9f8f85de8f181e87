"""voxelframe: DataFrame operators for volumetric-scan analytics on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# kernels travel to the executors by value, so these do not need the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
