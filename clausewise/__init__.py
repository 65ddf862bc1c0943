"""clausewise: document-compliance auditing as Spark DataFrame jobs.

Every operator takes and returns DataFrames; per-document work is expressed as
Column expressions (narrow, no shuffle), and the few aggregations that need a
shuffle are partial-aggregated.  See README.md for the operator map.
"""

import sys

from pyspark import cloudpickle

from clausewise.session import get_spark, checkpoint_dir, load_table  # noqa: F401

# Functions shipped to Python workers (pandas UDFs, mapInPandas,
# applyInPandas) are pickled by value, so executors need no installed copy of
# this package: it works from any working directory or cluster node.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["get_spark", "checkpoint_dir", "load_table"]
