"""folioflow: Spark-first analytics over nested book -> page -> area records."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors inside the task, so that no
# installation is needed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
