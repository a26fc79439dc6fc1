"""tallyforge: work-ledger and code-quality analytics on Spark.

Python functions that Spark runs on executors are pickled by value, so a
cluster needs nothing of this package installed on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
