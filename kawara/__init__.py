"""kawara: local-news feeds turned into a catalogue of newly opened shops, as composable Spark transformations."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job, so executors needn't have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
