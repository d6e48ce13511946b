"""Training-data operators.  Nothing else in the library imports this
subpackage; ``__spark_entry__`` adds its queries when it is present."""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel with the job: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
