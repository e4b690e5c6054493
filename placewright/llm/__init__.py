"""Operators for preparing training data: duplicates, toxicity, mixing, tokens, chats and vector search."""

import sys

from pyspark import cloudpickle

# executors need no copy of this package: functions that run in tasks are sent with their code
cloudpickle.register_pickle_by_value(sys.modules[__name__])
