"""Billing analytics and incident detection as Spark jobs."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Python workers need not find this package on their own path: functions travel with the job.
register_pickle_by_value(sys.modules[__name__])
