"""Telemetry and experiment analytics as PySpark DataFrame operators.

Python code that runs in tasks travels with the plan: the package need not be
installed on the executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
