"""State-change detection in sampled power signals, on Spark DataFrames and streams."""

import sys

from pyspark import cloudpickle

from wattshift.config import DetectorParams

# Python tasks get this package's code with their closure, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["DetectorParams"]
