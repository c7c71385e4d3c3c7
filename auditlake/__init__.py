"""Audits of prompts and source files as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions of this package that run in tasks travel with the job; executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
