"""Finds where a long trajectory leaves the region that a reference set covers."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
__version__ = "0.2.0"
