"""A Spark-native engine that finds, scores, removes and audits sensitive data in text."""

import sys

from pyspark import cloudpickle

from veilwork.api import Client, Config, ConfigurationError, DetectionError, Session, SessionExpired, VeilworkError, redact, restore, scan

__all__ = ["Client", "Config", "ConfigurationError", "DetectionError", "Session", "SessionExpired", "VeilworkError", "redact", "restore", "scan"]

# Functions that run in Python workers are shipped by value, with all they reach, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
