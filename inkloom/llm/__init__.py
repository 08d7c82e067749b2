"""Operators for preparing training text: one module per operator, queries in ``catalog``."""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
