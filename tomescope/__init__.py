"""tomescope: semantic retrieval and recommendation over catalogue tables, on Spark.

Every operator is a function ``DataFrame -> DataFrame`` built from the DataFrame API,
window functions, Spark ML and Arrow (pandas) UDFs. There is no engine layer of our own.
"""

from tomescope.config import Params  # noqa: F401
from tomescope.session import get_spark, scratch_dir  # noqa: F401

__all__ = ["Params", "get_spark", "scratch_dir"]
