"""corpusmill: a PySpark-native engine for preparing and auditing conversational and text corpora."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to executors carry their own code, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
