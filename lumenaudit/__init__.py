"""lumenaudit: bulk website-audit analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code along: the package needs no installation there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
