"""Search, extraction and audits over finished web crawls, as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel with the job, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
