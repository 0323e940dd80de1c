"""Operators for training-data pipelines. Nothing else in the library imports this subpackage."""

from pyspark import cloudpickle

import devicelog

# Functions travel to the executors whole, so the package need not be installed there.
cloudpickle.register_pickle_by_value(devicelog)
