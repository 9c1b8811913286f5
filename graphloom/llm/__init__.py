"""Operators for preparing training text at scale.

Nothing else in the package imports this folder.  Worker-side code is pickled
by value so that executors need no installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
