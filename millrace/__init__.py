"""Corpus preparation, batch retrieval and log analytics as PySpark jobs.

Functions that run inside Spark tasks are shipped with the job (pickled by value), so
executors need numpy, pandas and pyarrow but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
