"""Operators for preparing training text at corpus scale.

Nothing else in the library imports this subpackage. Task functions travel to the executors
with their code, so a cluster needs no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
