"""Keeps two large keyed collections in sync on Spark, proves it, and reports what it cost."""

import sys

from pyspark import cloudpickle

# The few Python helpers that run in tasks travel with the job, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
