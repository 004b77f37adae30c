"""Operators for preparing training data. Nothing else in the library imports this subpackage.

Functions that run in Python workers travel with their code, so executors need the third-party libraries
but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
