"""phylospark: comparative-genomics tables and text corpora as Spark jobs.

The functions that run inside Python workers are pickled by value, so a
cluster needs no copy of this package on its executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
