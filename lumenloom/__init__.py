"""lumenloom: a Spark-native engine for preparing and evaluating image-text training data."""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel with their code, so executors need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
