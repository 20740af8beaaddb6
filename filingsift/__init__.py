"""Spark jobs over labelled document corpora: tables in, tables out."""
import sys

from pyspark import cloudpickle

# the small Python helpers of Arrow functions travel with their tasks, so executors need no install
cloudpickle.register_pickle_by_value(sys.modules[__name__])
