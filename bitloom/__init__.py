"""Boolean matrix analytics on Spark."""

import sys

from pyspark import cloudpickle

# functions sent to executors carry this package's code with them: executors need not have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
