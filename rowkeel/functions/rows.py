"""Row-local column functions: pure expressions, equally valid on a batch or a streaming frame."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse_globs(text: str | None) -> list[str]:
    """A comma list of glob patterns, trimmed, without blanks."""
    return [p.strip() for p in (text or "").split(",") if p.strip()]


def glob_regex(pattern: str) -> str:
    """The anchored expression of a glob: ``*`` any run (dots too), ``?`` one character."""
    body = "".join(".*" if ch == "*" else "." if ch == "?" else re.escape(ch) for ch in pattern)
    return f"(?is)^{body}$"


def name_matches(name: str, patterns: Iterable[str]) -> bool:
    """Does a ``schema.table`` name match any pattern? Patterns without a dot also try the bare name."""
    bare = name.split(".", 1)[-1]
    for p in patterns:
        rx = re.compile(glob_regex(p))
        if rx.match(name) or ("." not in p and rx.match(bare)):
            return True
    return False


def glob_match(value: Column | str, patterns: Iterable[str]) -> Column:
    """:func:`name_matches` as a column over qualified names."""
    value = F.col(value) if isinstance(value, str) else value
    bare = F.regexp_replace(value, r"(?s)^[^.]*\.", "")
    hit = F.lit(False)
    for p in patterns:
        rx = glob_regex(p)
        hit = hit | value.rlike(rx)
        if "." not in p:
            hit = hit | bare.rlike(rx)
    return hit


def live(df: DataFrame, flag: str = "deleted_at") -> DataFrame:
    """Rows that are not soft-deleted."""
    return df.where(F.col(flag).isNull())


def content_key(text: Column | str) -> Column:
    """Checksum of a text that does not depend on the newline style."""
    text = F.col(text) if isinstance(text, str) else text
    return F.sha2(F.replace(text, F.lit("\r\n"), F.lit("\n")), 256)


def _places_of_nulls(value: Column, kind: T.DataType) -> list[Column]:
    out = [value.isNull()]
    if isinstance(kind, T.ArrayType):
        out += [F.size(value), F.transform(value, lambda x: F.struct(*_places_of_nulls(x, kind.elementType)))]
    elif isinstance(kind, T.StructType):
        out += [place for f in kind.fields for place in _places_of_nulls(value.getField(f.name), f.dataType)]
    return out


def row_hash(df: DataFrame, columns: list[str]) -> Column:
    """64 bits that stand for the values of some columns: equal rows have equal ones, NULLs, NaN and signed zeros as in a grouping.

    Hashes pass over NULLs, also inside arrays and structs, so the places of these are hashed as well.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    values = [F.col(f"`{c}`") for c in columns]
    return F.xxhash64(*values, *[place for c, v in zip(columns, values) for place in _places_of_nulls(v, kinds[c])])


def expired(df: DataFrame, due: str, asof: Column | object, guard: str | None = None) -> DataFrame:
    """Rows whose due time has passed at ``asof`` and for which ``guard`` (not yet done) holds."""
    late = F.col(due) <= (asof if isinstance(asof, Column) else F.lit(asof))
    return df.where(late if guard is None else late & F.expr(guard))


def valid_json(text: Column | str) -> Column:
    """True for NULL or parseable JSON."""
    text = F.col(text) if isinstance(text, str) else text
    return text.isNull() | F.try_parse_json(text).isNotNull()


def _exact_number(number: Column) -> Column:
    """A JSON number as its digits and a power of ten, the same for all spellings: ``1.50``, ``15e-1`` and ``1.5`` give ``15e-1``."""
    group = lambda i: F.regexp_extract(number, r"^-?(\d+)(?:\.(\d*))?(?:[eE]([+-]?\d+))?$", i)
    digits = F.regexp_replace(F.concat(group(1), group(2)), "^0+", "")
    bare = F.regexp_replace(digits, "0+$", "")
    power = F.coalesce(group(3).try_cast("bigint"), F.lit(0)) - F.length(group(2)) + F.length(digits) - F.length(bare)
    sign = F.when(number.startswith("-"), "-").otherwise("")
    return F.when(bare == "", "0").otherwise(F.concat(sign, bare, F.lit("e"), power.cast("string")))


def canonical_json(text: Column | str) -> Column:
    """One spelling of every JSON value: no blanks, keys in order, escapes resolved, numbers by value whatever their digits.

    Texts are equal after this just when the database's binary JSON would be. A text that is no JSON, or repeats a key in an object, is
    kept as it is behind a mark; NULL stays NULL. Numbers and texts are marked (``n``, ``s``) before the keys are sorted, so no
    precision is lost and a text never equals a number.
    """
    text = F.col(text) if isinstance(text, str) else text
    tokens = F.regexp_extract_all(text, F.lit(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|-?\d[\d.eE+-]*|[^"\d-]+|-'), F.lit(0))
    marked = F.transform(
        tokens,
        lambda t: F.when(t.startswith('"'), F.concat(F.lit('"s'), F.substr(t, F.lit(2))))
        .when(t.rlike("^-?[0-9]"), F.concat(F.lit('"n'), _exact_number(t), F.lit('"')))
        .otherwise(t),
    )
    plain = F.to_json(F.try_parse_json(F.array_join(marked, "")))
    parsed = F.try_parse_json(text).isNotNull()
    return F.when(text.isNotNull(), F.coalesce(F.when(parsed, plain), F.concat(F.lit("not JSON: "), text)))


def int_array(text: Column | str) -> Column:
    """``{1,2,NULL}`` as an integer array; a malformed text gives NULL."""
    text = F.col(text) if isinstance(text, str) else text
    inner = F.regexp_extract(text, r"^\{(.*)\}$", 1)
    parts = F.transform(F.split(inner, ","), lambda p: F.trim(p))
    well_formed = text.rlike(r"(?i)^\{\s*(([-+]?\d+|null)\s*(,\s*([-+]?\d+|null)\s*)*)?\}$")
    numbers = F.transform(parts, lambda p: p.try_cast("int"))
    fits = F.forall(parts, lambda p: p.try_cast("int").isNotNull() | (F.lower(p) == "null"))
    empty = F.array().cast("array<int>")
    return F.when(~well_formed, None).when(F.trim(inner) == "", empty).when(fits, numbers)


def float_vector(text: Column | str) -> Column:
    """``[0.5,1]`` as a float array; a malformed text gives NULL."""
    text = F.col(text) if isinstance(text, str) else text
    parts = F.split(F.regexp_extract(text, r"^\s*\[(.*)\]\s*$", 1), ",")
    numbers = F.transform(parts, lambda p: F.trim(p).try_cast("float"))
    return F.when(text.rlike(r"^\s*\[.*\]\s*$") & F.forall(numbers, lambda v: v.isNotNull()), numbers)


def uuid_text(value: Column) -> Column:
    """The usual spelling of a UUID: lower case, five groups. Upper case, braces and other places of hyphens are understood; else NULL."""
    groups = r"[0-9a-fA-F]{4}(-?[0-9a-fA-F]{4}){7}"
    digits = F.lower(F.regexp_replace(value, "[-{}]", ""))
    parts = [F.substring(digits, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(value.rlike(rf"^(?:{groups}|\{{{groups}\}})$"), F.concat_ws("-", *parts))


def time_text(value: Column, zone: bool = False) -> Column:
    """A time of day as ``HH:mm:ss`` with up to six decimals, from 00:00:00 to 24:00:00; with ``zone`` its offset follows. Else NULL."""
    clock = r"(?:[01]\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:\.\d{1,6})?)?|24:00(?::00(?:\.0{1,6})?)?"
    offset = r"(?:[+-](?:0\d|1[0-5])(?::[0-5]\d(?::[0-5]\d)?)?|Z)" if zone else ""
    bare = F.regexp_extract(value, r"^[\d:.]+", 0)
    # decimals lose the zeros at their end, and the point with them where nothing is left
    cut = F.regexp_replace(F.regexp_replace(bare, "0+$", ""), r"\.$", "")
    whole = F.when(F.instr(bare, ".") > 0, cut).when(F.length(bare) == 5, F.concat(bare, F.lit(":00"))).otherwise(bare)
    return F.when(value.rlike(rf"^(?:{clock}){offset}$"), F.concat(whole, F.substr(value, F.length(bare) + 1)))


def exceeds_scale(raw: Column, kept: Column, scale: int) -> Column:
    """Whether the number in the text ``raw`` has digits, other than zeros, beyond ``scale``, which ``kept`` has lost."""
    beyond = raw.rlike(rf"\.\d{{{scale}}}\d*[1-9]")
    scientific = raw.rlike("[eE]")
    return F.when(scientific, raw.try_cast("double") != kept.cast("double")).otherwise(beyond)
