"""ledgerlake: document-extraction data work as Spark DataFrame jobs.

Every public operator takes and returns DataFrames; scalar pieces are
``Column -> Column`` functions so Catalyst can push down, prune and codegen
them like any built-in expression.
"""

import sys as _sys

__version__ = "0.1.0"

# The few Python functions shipped to executors (pandas UDFs, mapInPandas
# bodies) are pickled by value, so workers never need this package on their
# path: nothing to install on the cluster besides the driver.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle without the API
    pass
