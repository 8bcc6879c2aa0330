"""Operators for preparing training corpora.  Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# Executors need not have this package on their path: its functions travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
