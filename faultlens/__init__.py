"""faultlens: root-cause analysis over operations logs as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# batch functions travel to the executors by value, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
