"""Operators of a training-data pipeline: ten text operators, their queries
(``queries.py``) and shared helpers.  Nothing outside this folder imports it.

Functions that run in Python workers are pickled by value, so executors need
no copy of this package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
