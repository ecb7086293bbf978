"""vitrine: catalog ingestion, reconciliation and analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# The few Python functions are sent to the executors whole, so those need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
