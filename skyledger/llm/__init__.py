"""Operators for large text corpora, each a Spark job over whole tables.

Nothing outside this folder imports it. Functions that run in tasks are sent with
the job, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
