"""Training-data operators: quality, licences, packing, tokens, chats, media and deduplication."""

import sys

from pyspark import cloudpickle

# Tasks get these functions by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
