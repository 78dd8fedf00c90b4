"""Web-content aggregation as Spark DataFrames: crawl planning, extraction,
normalization, filtering, aggregation and output, in batch and streaming."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel by value, so the workers of a
# cluster need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
