"""Freight-mail triage and document audit as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so a cluster needs no extra
# --py-files for the few Arrow functions the engine has.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
