"""evidra: an evidence engine on Spark.

Every public operator is a plain ``DataFrame -> DataFrame`` function; see README.md for the map.
"""

import sys

from pyspark import cloudpickle

# functions and classes that run in Python workers travel with the job, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
