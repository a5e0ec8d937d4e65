"""Operators for preparing language-model training corpora.

The functions that run inside Python workers are pickled by value, so that
executors need this package on no path of their own.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
