"""Operators for training-data pipelines: text rules, scans, deduplication, tokens.

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Functions and classes of this subpackage travel to executors with the tasks, so the
# package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
