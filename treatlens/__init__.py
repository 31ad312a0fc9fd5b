"""Treatment-versus-control analytics on entity-by-feature tables, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions handed to mapInArrow / applyInPandas travel with their code, so a
# cluster needs no separate install of this package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
