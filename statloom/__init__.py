"""PySpark-native toolkit for tabular statistics: cleaning, modelling, checks, tests, chart data."""

import sys

from pyspark import cloudpickle

# The helpers inside Arrow functions travel with them, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
