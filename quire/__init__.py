"""quire: document pipelines as Spark DataFrame jobs.

Every operator is a function ``DataFrame(s) -> DataFrame`` built from native
Spark expressions where possible; Python runs only inside Arrow-batched
pandas functions where the built-ins cannot express the work (vector
distance blocks, pluggable embedders, user-defined table functions).
"""

__version__ = "0.1.0"

import sys as _sys

try:
    # ship our functions and classes to Python workers by value: pandas
    # functions, the numpy kernels and the stateful streaming processor then
    # run in any worker (including the streaming state runner) without the
    # package being installed there
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: fall back to ship_package
    pass
