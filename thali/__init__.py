"""thali: order, customer and payment analytics as PySpark DataFrame jobs.

Every public operator is a pure ``DataFrame -> DataFrame`` function built
from Spark's own column functions.  Nothing inside an operator triggers an
action; the caller decides when to run, cache or write.
"""

from thali.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
