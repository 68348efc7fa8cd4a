"""Batch jobs for company disclosure analytics on Spark, and operators for training-data pipelines."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# functions that run in tasks travel with the job, so executors needn't have this package installed
register_pickle_by_value(sys.modules[__name__])
