"""rationflow: least-cost rations, growth and farm economics on Spark."""

from __future__ import annotations

import sys as _sys

try:  # ship the package's pandas functions to Python workers by value, so
    # executors need no installed copy of this package
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

__all__ = ["session"]
