"""specgrade: Spark-native corpus preparation and constraint-evaluation operators.

Every public operator is a ``DataFrame -> DataFrame`` (or ``Column -> Column``)
function built from Spark SQL expressions, joins, windows and aggregations.
"""

import sys

from pyspark import cloudpickle

from specgrade.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]

# The functions of this package travel with the tasks that call them, so
# executors need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
