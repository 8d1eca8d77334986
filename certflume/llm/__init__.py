"""Operators for training-data corpora. Nothing else in the package imports this subpackage."""

import sys

from pyspark import cloudpickle

# As in the parent package: helpers travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
