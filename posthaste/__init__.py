"""Curation, annotation and scoring of social posts as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value, so that executors need no
# copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
