"""Batch structuring of long-form sources into notes, as DataFrame operations."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry this package's code: nothing need be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
