"""leadloom: lead and outreach analytics as PySpark DataFrame operators.

Every operator is a function from DataFrames (and plain parameters) to a DataFrame. Nothing here
collects data to the driver, writes tables on its own, or reads the clock: ``now`` is a parameter.
"""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel by value: executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
