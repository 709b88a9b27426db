"""Inputs and expected results for the registered queries."""

import sys

from pyspark import cloudpickle

# The sample embedder runs inside tasks; see webstrata/__init__.py.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
