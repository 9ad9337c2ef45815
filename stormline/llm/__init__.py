"""Operators on text collections for training-data pipelines: filters, deduplication, archives, packing."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the executors as code, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
