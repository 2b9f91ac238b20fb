"""Secret scans over an incremental blob ledger, in DataFrame functions only.

A *blob* is a text named by its SHA-256. The ledger holds one row per blob and rule version that were scanned, with the
spans found (also when there are none). A scan of new versions hashes them, keeps each blob once, drops the
(blob, rule version) pairs that the ledger has, scans the rest, appends, and joins the spans back to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowkeel.llm.common import free_name, table, text_of
from rowkeel.sources.staging import path_exists, scratch_path


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds spans, leftmost first and without overlaps; those whose ``group`` has fewer than ``least`` code points are dropped.

    Raise ``version`` when the pattern changes: blobs are then scanned again for this rule only.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The kinds of the contract, in its order.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    # a run of fewer than 32 is never part of a longer run, so the bound may stand in the pattern
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Kinds that the ledger adds: signed web tokens and private key headers.
MORE = (
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
RULES = BASE + MORE

_SPANS = "array<struct<start:long,end:long>>"
LEDGER = f"blob string, rule string, spans {_SPANS}"


def spans_of(text: Column, rule: Rule) -> Column:
    """The spans of one rule as code points, end exclusive: the gaps between matches and the matches alternate."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    wanted = whole if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    steps = F.arrays_zip(gaps.alias("gap"), F.transform(whole, F.length).alias("len"), F.transform(wanted, F.length).alias("part"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPANS).alias("found"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + x["gap"]
        end = begin + F.coalesce(x["len"], F.lit(0))
        hit = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["part"] >= rule.least, F.concat(a["found"], hit)).otherwise(a["found"]).alias("found"))

    found = F.aggregate(steps, start, step, lambda a: a["found"])
    return F.when(F.rlike(text, F.lit(rule.pattern)), found).otherwise(F.array().cast(_SPANS))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows: the (blob, rule version) pairs of ``versions`` (``blob, text``) that ``ledger`` lacks.

    Texts are shuffled once, by blob, and copies of a blob are dropped before that shuffle.
    """
    blobs = versions.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is None:
        seen = F.array().cast("array<string>")
    else:
        known = ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        blobs = blobs.join(known, "blob", "left")
        seen = F.coalesce("seen", F.array().cast("array<string>"))
    entries = F.array(
        *[
            F.when(~F.array_contains(seen, r.key), F.struct(F.lit(r.key).alias("rule"), spans_of(F.col("text"), r).alias("spans")))
            for r in rules
        ]
    )
    return blobs.select("blob", F.inline(F.filter(entries, lambda e: e.isNotNull())))


class Ledger:
    """A ledger in a Parquet folder that all executors share; each scan appends one job's files."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch_path(spark, "ledger")

    def rows(self) -> DataFrame | None:
        return self.spark.read.schema(LEDGER).parquet(self.path) if path_exists(self.spark, self.path) else None

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> None:
        """Bring the ledger up to date with every text of ``versions`` (``blob, text``)."""
        scan_unseen(versions, self.rows(), rules).write.mode("append").parquet(self.path)

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """``blob, found``: one row per blob with any span of these rule versions; kinds stand in the order of ``rules``."""
        number = F.array_position(F.array(*[F.lit(r.key) for r in rules]), F.col("rule"))
        hit = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), number.alias("kind"), s["end"].alias("end")))
        mine = self.rows().where(F.col("rule").isin([r.key for r in rules]) & (F.size("spans") > 0))
        return mine.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list(hit))).alias("found"))


def blob_of(text: Column) -> Column:
    return F.sha2(text, 256)


def _joined(found: Column, rules: tuple[Rule, ...], base_only: bool) -> Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    kept = F.filter(found, lambda s: s["kind"] <= len(BASE)) if base_only else found
    parts = F.transform(kept, lambda s: F.concat_ws(":", F.get(names, (s["kind"] - 1).cast("int")), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(parts, ",")


def _count(found: Column, number: int) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == number)).cast("long")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its spans: texts scanned once per blob, joined back to all rows.

    A null text is the empty text; equal texts share a blob; repeated rows and null ids keep their rows; extra columns
    are ignored; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", text_of().alias("text")).withColumn("blob", blob_of(F.col("text")))
    ledger = Ledger(spark)
    ledger.scan(docs.select("blob", "text"))
    none = F.array().cast("array<struct<start:long,kind:long,end:long>>")
    found = docs.select("doc_id", "blob").join(ledger.findings(), "blob", "left").withColumn("found", F.coalesce("found", none))
    return found.select(
        "doc_id",
        *[_count(F.col("found"), i + 1).alias(f"n_{r.kind}") for i, r in enumerate(BASE)],
        F.sha2(_joined(F.col("found"), RULES, True), 256).alias("base_sha256"),
        _joined(F.col("found"), RULES, False).alias("spans"),
    )


def _rule_sql(number: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""SELECT rid, {number} AS kind, '{rule.kind}' AS name, {rule.least} AS least,
      list_transform(string_split_regex(t, '{pattern}'), lambda x: length(x)) AS gaps,
      list_transform(regexp_extract_all(t, '{pattern}', 0), lambda x: length(x)) AS lens,
      list_transform(regexp_extract_all(t, '{pattern}', {rule.group}), lambda x: length(x)) AS parts FROM d"""


def _text_sql(where: str) -> str:
    return f"coalesce(string_agg(name || ':' || a || ':' || z, ',' ORDER BY a, kind) FILTER ({where}), '')"


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_rule_sql(i + 1, r) for i, r in enumerate(RULES))}),
n AS (SELECT *, unnest(range(1, len(lens) + 1)) AS i FROM m),
s AS (
  SELECT rid, kind, name, (list_sum(gaps[1:i]) + coalesce(list_sum(lens[1:i-1]), 0))::BIGINT AS a,
    (list_sum(gaps[1:i]) + list_sum(lens[1:i]))::BIGINT AS z
  FROM n WHERE parts[i] >= least
)
SELECT d.doc_id, {", ".join(f"count(*) FILTER (kind = {i + 1}) AS n_{r.kind}" for i, r in enumerate(BASE))},
  sha256({_text_sql(f"kind <= {len(BASE)}")}) AS base_sha256, {_text_sql("kind > 0")} AS spans
FROM d LEFT JOIN s USING (rid) GROUP BY rid, d.doc_id
"""


def without_secrets(docs: DataFrame, ledger: Ledger, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span replaced by ``mark`` and all columns kept; overlapping spans make one mark.

    The columns of ``docs`` may have any names; ``n_chars`` follows the new text where there is one.
    """
    blob, found = free_name(docs, "blob"), free_name(docs, "found")
    named = docs.withColumn(blob, blob_of(text_of()))
    ledger.scan(named.select(F.col(blob).alias("blob"), text_of().alias("text")))
    hits = ledger.findings().toDF(blob, found)
    text = F.col("text")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    masked = F.aggregate(
        F.col(found),
        start,
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["start"] < a["at"], a["out"])
            .otherwise(F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mark)))
            .alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.lit(2**31 - 1))),
    )
    joined = named.join(hits, blob, "left").withColumn("text", F.when(F.col(found).isNull(), text).otherwise(masked))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(F.col(found).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return joined.select(*docs.columns)
