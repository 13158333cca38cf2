"""Text-corpus curation and analytics as composable Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that a cluster
# needs neither an installed copy nor a PYTHONPATH.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
