"""Operators for training-data pipelines. Nothing else in the library imports this package.

Functions of this package travel to Spark's Python workers by value, so the workers need not
have it installed; large ones (a model, a vocabulary) are broadcast by Spark itself.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
