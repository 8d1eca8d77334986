"""Certificate-stream analytics as PySpark DataFrame operators.

Every operator is ``DataFrame -> DataFrame`` or ``Column -> Column``; the work
is declared and Catalyst picks the physical plan.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The small helpers behind the Arrow UDFs travel with the plan, so executors
# need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
