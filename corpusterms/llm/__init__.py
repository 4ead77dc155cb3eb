"""Training-data operators: deduplication, sharding, packing, language ID, ...

Nothing else in the library imports this package.  Functions that run inside
Python tasks are pickled by value, so executors need no copy of the package
(only the public libraries it uses).
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
