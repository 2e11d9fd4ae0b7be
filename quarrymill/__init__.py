"""Corpus jobs on Spark: ingest, chunking, retrieval, draft checks, catalogue upkeep and streaming, all as DataFrame code."""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel with the job, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
