"""Operators for preparing language-model training data; nothing else in the library imports them.

Functions sent to Python workers carry the code of this package, so workers need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
