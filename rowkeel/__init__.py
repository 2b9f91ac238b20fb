"""rowkeel: moving and guarding relational data sets on Spark.

Tables are Spark DataFrames held in a ``Frames`` dictionary (``schema.table`` -> DataFrame)
and described by one plain constraint specification (:mod:`rowkeel.spec`).
"""

from rowkeel.spec import Check, Column, ForeignKey, PolymorphicKey, Spec, Table, Unique

__all__ = ["Check", "Column", "ForeignKey", "PolymorphicKey", "Spec", "Table", "Unique"]
