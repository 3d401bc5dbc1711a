"""cellweave: messy tables to tidy frames, expressed as Spark plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions run by Python workers travel with the plan; executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
