"""Operators for training-data pipelines over tables of documents and pages.

Nothing else in the library imports this package. Functions that run in Python workers travel with their code.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
