"""Operators for training-data pipelines over text, embeddings and conversations."""

import sys

from pyspark import cloudpickle

# functions sent to executors carry their code, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
