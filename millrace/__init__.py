"""millrace: a PySpark-native engine for dataflow, versioned data, streams and training-data work."""

import sys

from pyspark import cloudpickle

# Functions that run on executors carry their code along, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
