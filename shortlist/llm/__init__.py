"""Operators for preparing large text collections for training.

Worker functions of this subpackage are shipped by value, so executors need not have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
