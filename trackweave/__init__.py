"""Match-and-track data work on listings and free text, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Python tasks receive this package's functions by value: executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
