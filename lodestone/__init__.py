"""Lodestone: retrieval analytics and corpus processing as Spark plans."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their code, so that a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
