"""corpusflow: retrieval and conversation data processing as Spark DataFrame jobs.

Every function takes and returns DataFrames (or Columns); none owns a session.
"""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with the job, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
