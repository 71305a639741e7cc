"""Operators for large-scale training-data pipelines.

Each module holds one operator; ``queries`` registers one query per operator
over the whole of its table.  Nothing else in the library imports this
subpackage.
"""

import sys

from pyspark import cloudpickle

# The functions of this subpackage travel with the tasks that call them, so
# executors need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
