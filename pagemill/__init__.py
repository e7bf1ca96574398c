"""pagemill: page-to-article analytics as Spark DataFrame jobs.

Sub-packages:
  sources    -- table readers, constructed fixtures, sinks
  functions  -- Column-expression builders (text, urls, scoring, classes)
  operators  -- DataFrame -> DataFrame operators (dom, fields, images, ...)
  plans      -- composed jobs and the query registry
  streaming  -- the stream form of the batch jobs
"""

__version__ = "0.1.0"

import sys as _sys

try:
    # Python steps (the HTML parse, two small UDFs) are closures over this
    # package. Pickling it by value ships the code with the task, so executors
    # need no installed copy.
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - pyspark absent or older cloudpickle
    pass
