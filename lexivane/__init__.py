"""Text-embedding and retrieval-evaluation operators on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the task, so that executors need
# no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
