"""skein: a PySpark-native engine for curating, labelling and evaluating conversation transcripts."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Python functions travel to the executors with their code, so workers need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
