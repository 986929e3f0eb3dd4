"""lakeshift: change-data-capture logs -> versioned tables, and lineage queries, on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package run inside Arrow-batched Python tasks (mapInArrow); ship them
# by value so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
