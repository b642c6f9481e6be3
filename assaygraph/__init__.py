"""assaygraph: Spark-native operators for labelled-measurement tables.

Every operator is a function from DataFrame(s) to DataFrame(s) that runs on
executors; driver-side work is limited to bounded metadata (column names,
category lists behind a size check, p x p matrices, threshold grids, counts).
"""

import sys as _sys

__version__ = "0.1.0"

# Python kernels (block distance kernels, stream batch functions) are shipped
# to executors by value, so workers need no installed copy of this package.
try:  # pragma: no cover - depends on the PySpark build
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass
