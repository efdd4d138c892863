"""Punctuality analytics on Spark: how far timed events depart from their plan."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with the job, so the workers need
# not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
