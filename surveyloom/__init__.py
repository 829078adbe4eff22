"""Panel analytics on Spark: table operators for multi-year questionnaire data."""

import sys

from pyspark import cloudpickle

# Python workers get the few functions they run by value, so executors need not
# have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
