"""Operators for preparing large text corpora; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors inside the tasks, so that a cluster needs no
# copy of it on the workers' import path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
