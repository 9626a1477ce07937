"""Document-layout and document-event analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Helper functions travel to executors with the job; no package install needed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["functions", "operators", "sources", "plans", "streaming"]
