"""COPY text: tab-separated lines, ``\\N`` for NULL, backslash escapes, one row per line.

Everything stays in built-in expressions, so a dump is written and read as a splittable
text source by as many tasks as it has splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowkeel.functions.rows import float_vector, int_array

# Fixed values of the COPY text format: character -> escape letter after the backslash.
ESCAPES = {"\b": "b", "\t": "t", "\n": "n", "\v": "v", "\f": "f", "\r": "r"}
NULL_MARK = "\\N"
_NEEDS_ESCAPE = "[\\\\\b\t\n\u000b\f\r]"


def escape_field(value: Column) -> Column:
    """Text with the backslash and the control characters escaped."""
    out = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    for char, letter in ESCAPES.items():
        out = F.replace(out, F.lit(char), F.lit("\\" + letter))
    return F.when(value.rlike(_NEEDS_ESCAPE), out).otherwise(value)


def unescape_field(value: Column) -> Column:
    """Inverse of :func:`escape_field`.

    Splitting on the escaped backslash first leaves pieces in which a backslash can only
    start a control escape.
    """

    def piece(p: Column) -> Column:
        for char, letter in ESCAPES.items():
            p = F.replace(p, F.lit("\\" + letter), F.lit(char))
        return p

    whole = F.array_join(F.transform(F.split(value, r"\\\\", -1), piece), "\\")
    return F.when(value.contains("\\"), whole).otherwise(value)


def encode_value(value: Column, kind: T.DataType) -> Column:
    """The COPY text of one column, before NULL handling."""
    if isinstance(kind, T.BooleanType):
        return F.when(value, "t").when(~value, "f")
    if isinstance(kind, T.TimestampType):
        seconds = (F.unix_micros(value).cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
        utc = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds)
        return F.concat(F.date_format(utc, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+00"))
    if isinstance(kind, T.TimestampNTZType):
        return F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if isinstance(kind, T.BinaryType):
        return F.concat(F.lit("\\\\x"), F.lower(F.hex(value)))
    if isinstance(kind, T.ArrayType):
        opening, closing = ("{", "}") if isinstance(kind.elementType, T.IntegralType) else ("[", "]")
        items = F.array_join(value.cast("array<string>"), ",", "NULL")
        return F.when(value.isNotNull(), F.concat(F.lit(opening), items, F.lit(closing)))
    if isinstance(kind, T.StringType):
        return escape_field(value)
    return value.cast("string")


def decode_value(raw: Column, kind: T.DataType) -> Column:
    """A typed value from unescaped text; NULL where the text does not fit the type."""
    if isinstance(kind, T.StringType):
        return raw
    if isinstance(kind, T.BooleanType):
        return F.when(raw.isin("t", "true"), True).when(raw.isin("f", "false"), False)
    if isinstance(kind, T.BinaryType):
        return F.when(raw.startswith("\\x"), F.unhex(F.substr(raw, F.lit(3))))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.IntegralType):
            return int_array(raw).cast(kind)
        return float_vector(raw).cast(kind)
    if isinstance(kind, T.TimestampType):
        return F.try_to_timestamp(raw)
    return raw.try_cast(kind)


def copy_line(df: DataFrame) -> Column:
    """One COPY text line per row, over all columns of ``df`` in order."""
    fields = [
        F.coalesce(encode_value(F.col(f"`{f.name}`"), f.dataType), F.lit(NULL_MARK)) for f in df.schema.fields
    ]
    return F.concat_ws("\t", *fields)


def split_line(line: Column, n: int) -> Column:
    """The raw fields of a line: cut at literal tabs, the last field keeps the rest."""
    return F.split(line, "\t", n)


def write_copy(df: DataFrame, path: str) -> None:
    """Write one table as COPY text; an existing target is refused."""
    df.select(copy_line(df).alias("value")).write.mode("errorifexists").text(path, lineSep="\n")


def copy_lines(spark: SparkSession, path: str) -> DataFrame:
    """The raw lines of a COPY text folder, as ``value``; only a newline ends a line."""
    return spark.read.text(path, lineSep="\n")


def text_columns(lines: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """Raw lines as unescaped string columns; only the kept fields are built.

    A line with too few fields gives NULL in the missing ones.
    """
    keep = columns if keep is None else keep
    where = {c: i for i, c in enumerate(columns)}
    cut = lines.select(split_line(F.col("value"), len(columns)).alias("f"))
    fields = []
    for c in keep:
        raw = F.get(F.col("f"), F.lit(where[c]))
        fields.append(F.when(raw != NULL_MARK, unescape_field(raw)).alias(c))
    return cut.select(*fields)


def read_copy(
    spark: SparkSession, path: str, schema: T.StructType, keep: list[str] | None = None
) -> DataFrame:
    """COPY text as typed columns; ``schema`` lists every field of the file in order."""
    kinds = {f.name: f.dataType for f in schema.fields}
    names = [f.name for f in schema.fields]
    text = text_columns(copy_lines(spark, path), names, keep)
    return text.select(*[decode_value(F.col(f"`{c}`"), kinds[c]).alias(c) for c in text.columns])
