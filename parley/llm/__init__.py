"""Operations of a training-data pipeline: one module per operator, queries in ``registered``."""

import sys

from pyspark import cloudpickle

# Functions travel with their tasks, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
