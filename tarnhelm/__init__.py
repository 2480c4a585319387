"""Sensitive-data detection, policy, redaction and evidence as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Task functions travel with their code, so executors do not need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
