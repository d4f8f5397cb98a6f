"""Operators for preparing training data: scans, deduplication, scoring, mixing, packing."""

import sys

from pyspark import cloudpickle

# Tasks get the code of these modules with the function: executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
