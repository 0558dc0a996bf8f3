"""Operators over training text: cleaning, deduplication, scoring and packing.

Nothing outside this subpackage imports it. Functions that run inside tasks are shipped
by value, so executors need no installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
