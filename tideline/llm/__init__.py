"""Operators of a training-data pipeline, and their queries.

Functions of this package that run inside tasks travel to the executors by
value, so a cluster needs no installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
