"""A Spark-first engine for routing-visibility and outage analytics.

Every operator is a function from DataFrames to a DataFrame; nothing here
starts a session or runs a job unless its docstring says so.
"""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their code, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
