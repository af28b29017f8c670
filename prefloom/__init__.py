"""prefloom: preference data and evaluation on Spark."""

# Functions from this package run inside Python workers (model hooks via mapInPandas).
# Pickle them by value so workers need no installed copy of the package; when it is
# installed on the cluster this only makes task payloads slightly larger.
try:
    import sys as _sys

    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle: install the package on workers
    pass
