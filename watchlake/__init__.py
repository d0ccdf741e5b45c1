"""Watch-history analytics expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from watchlake.session import build_session, prepare_session

__all__ = ["build_session", "prepare_session"]

# Functions sent to Python workers carry their code, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
