"""seamline: review-fit analytics and large-table data processing on Spark."""

import sys

from pyspark import cloudpickle

# Workers get the package's functions with the task, so it need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
