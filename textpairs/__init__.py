"""textpairs: text-pair corpus preparation, batch assembly and evaluation on Spark.

Every operator is a function DataFrame -> DataFrame built from Spark SQL
built-ins; Python runs inside tasks only where a built-in cannot express the
rule (see README.md, "Python inside tasks").
"""

from textpairs.session import get_spark, checkpoint_base, scratch_path  # noqa: F401

__all__ = ["get_spark", "checkpoint_base", "scratch_path"]
