"""Lexical retrieval and corpus analytics on Spark DataFrames."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Executors receive this package's functions inside the task, so that it need not be installed on them.
register_pickle_by_value(sys.modules[__name__])
