"""Analytics over archives of multi-layer HDR images, written as Spark jobs.

Tables of channels, samples, pixels, attributes and log lines go in, tables come out.  Every operator
is a function ``DataFrame -> DataFrame`` that only builds a plan, so it can be used with
``df.transform(...)`` and composed freely.
"""

from lumigrid.session import build_session

__all__ = ["build_session"]
