"""cladeforge: phylogenomic analytics as Spark DataFrames.

Functions of this package are shipped to executors by value, so a cluster needs numpy, pandas and pyarrow there, but not this repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
