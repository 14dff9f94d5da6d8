"""Evidence retrieval and grounded answering over document collections, on PySpark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Arrow functions travel to executors whole, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
