"""Training-data operators: each module holds one operator, named in its docstring."""

import sys

from pyspark import cloudpickle

# Python workers get the operators' code with the task, so nothing needs installing on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
