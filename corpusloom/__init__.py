"""corpusloom: document question answering, retrieval and evaluation as Spark jobs.

Functions of this package travel to the executors by value, so a cluster needs
no copy of the package on its Python path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
