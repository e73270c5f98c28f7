"""Operators for large training-data pipelines.

One module per operator; ``queries`` registers a query for each of them.
Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Functions of these modules travel to the executors whole, so a job needs no
# copy of this package on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
