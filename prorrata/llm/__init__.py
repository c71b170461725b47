"""Operators for preparing training text, and their registered queries.

Nothing outside this folder imports it. The functions that run inside Python
workers travel by value, so workers need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
