"""Sequence-sketch analytics on Spark: sketching, indexing, classification."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

__version__ = "0.1.0"

# Functions sent to the executors carry their code with them: nothing has to be installed there but Spark's own needs.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

_PUBLIC = ("aggregate", "bucket_source_detail", "classify", "index_stats", "log_ratio", "read_reads")
__all__ = [*_PUBLIC, "SketchParams", "add", "create", "from_config", "merge"]


def __getattr__(name: str):
    """The public functions, imported when first asked for."""
    import importlib

    where = "api" if name in _PUBLIC else "functions.kernels" if name == "SketchParams" else "operators.pipeline"
    if name not in __all__:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(importlib.import_module(f"{__name__}.{where}"), name)
