"""A Spark-native engine for document retrieval, its evaluation, and training-data preparation."""

import sys

from pyspark import cloudpickle

# functions that run on executors travel with their task, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
