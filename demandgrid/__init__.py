"""demandgrid: retail demand analytics and forecasting as Spark jobs.

A *panel* is a DataFrame with one row per (unique_id, ds): the series key, a date and the
target ``y``.  Every operator takes DataFrames and returns a lazy DataFrame.
"""

import sys

from pyspark import cloudpickle

from demandgrid.functions.core import DS, ID, Y

# task functions travel with the job, so executors need no installed copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["ID", "DS", "Y"]
