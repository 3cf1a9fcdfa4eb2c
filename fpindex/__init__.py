"""Content fingerprints on Spark: digests, a hash index and queries over it."""

import sys

from pyspark import cloudpickle

# The few Python functions that run inside tasks travel with their job, so
# executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
