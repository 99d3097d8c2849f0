"""Operators for preparing large text collections for training, as Spark jobs.

Functions that run inside tasks travel by value, so executors need numpy and pyarrow but not
this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
