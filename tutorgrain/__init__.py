"""tutorgrain: a Spark-native engine for tutoring-dialogue evaluation data."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python workers get the engine's functions with the plan, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
