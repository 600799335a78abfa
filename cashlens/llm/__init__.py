"""Operators for training-data pipelines: search, screening, deduplication, mixing, tokens."""

import sys

from pyspark.cloudpickle.cloudpickle import register_pickle_by_value

# Functions that run in tasks travel with the job, so executors need not have this package installed.
register_pickle_by_value(sys.modules[__name__])
