"""gradus: scoring, ranking and corpus preparation as Spark jobs.

Functions that run inside Spark tasks travel with the job (pickled by value), so
executors need numpy, pandas and pyarrow, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
