"""Metadata, data-quality, lineage and retrieval analytics on Spark."""

import sys

from pyspark import cloudpickle

# Task-side helpers travel with the plan, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
