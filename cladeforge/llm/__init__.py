"""Training-data operators: filtering, tokenising, deduplicating, mixing, archiving and searching.

Functions of this package are shipped to executors by value, so a cluster needs
numpy, pyarrow and the tokenizer libraries there, but not this repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
