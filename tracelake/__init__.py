"""tracelake: security-telemetry and digital-evidence analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python functions of this package travel with the job, so that workers need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
