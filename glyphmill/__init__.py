"""Spark-native building blocks for text-recognition datasets.

Curation, profiling, evaluation, correction and reporting as DataFrame
functions: a DataFrame comes in, a DataFrame goes out.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers by value, so a job also
# runs where the package is installed on the driver only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
