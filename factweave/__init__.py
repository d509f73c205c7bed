"""factweave: a PySpark-native engine for evidence-grounded product analytics."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions travel to the executors by value, so no executor needs the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
