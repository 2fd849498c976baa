"""Rule-based reference selection, comparison and certification as Spark jobs.

Functions shipped to Python workers are pickled by value, so executors need no
installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
