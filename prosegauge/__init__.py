"""Build and audit scored prompt/continuation datasets with Spark."""

import sys

from pyspark import cloudpickle

# functions travel with the job, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
