"""The dump: a folder of COPY text tables and a manifest that its content is verified against."""

from __future__ import annotations

import hashlib
import json
import warnings
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from datetime import datetime, timezone

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rowkeel.functions.rows import name_matches, parse_globs
from rowkeel.sources.copytext import copy_line, copy_lines
from rowkeel.sources.staging import hadoop_path, path_exists, read_small_text, write_small_text
from rowkeel.sources.tables import per_name, with_all_tables
from rowkeel.spec import Frames, Spec

MANIFEST = "manifest.json"
SYSTEM_SCHEMAS = ("pg_catalog.*", "information_schema.*", "pg_toast.*")


def also_skipped(spark: SparkSession | None) -> list[str]:
    """The patterns of the session's setting ``spark.rowkeel.alsoSkip``, in addition to the database's own schemas."""
    return parse_globs(spark.conf.get("spark.rowkeel.alsoSkip", "")) if spark else []


@dataclass(frozen=True)
class DumpedTable:
    """One dumped table; ``file`` is relative to the dump folder."""

    name: str
    columns: list[str]
    rows: int
    bytes: int
    content_hash: str
    file: str


@dataclass(frozen=True)
class Manifest:
    dumped_at: str
    source: str
    fingerprint: str | None
    tables: list[DumpedTable]

    @property
    def rows(self) -> int:
        return sum(t.rows for t in self.tables)

    @property
    def bytes(self) -> int:
        return sum(t.bytes for t in self.tables)

    def save(self, spark: SparkSession, folder: str) -> None:
        write_small_text(spark, f"{folder}/{MANIFEST}", json.dumps(asdict(self), indent=2))

    def renamed(self, tables: dict[str, str], columns: dict[str, dict[str, str]]) -> Manifest:
        """Carry table and column renames (columns keyed by the new table name) into the dump."""
        out = []
        for t in self.tables:
            name = tables.get(t.name, t.name)
            cmap = columns.get(name, {})
            out.append(DumpedTable(name, [cmap.get(c, c) for c in t.columns], t.rows, t.bytes, t.content_hash, t.file))
        return Manifest(self.dumped_at, self.source, self.fingerprint, out)


def load_manifest(spark: SparkSession, folder: str) -> Manifest:
    path = f"{folder}/{MANIFEST}"
    if not path_exists(spark, path):
        raise FileNotFoundError(f"not a dump folder (no {MANIFEST}): {folder}")
    try:
        raw = json.loads(read_small_text(spark, path))
        tables = [DumpedTable(**t) for t in raw["tables"]]
        return Manifest(raw["dumped_at"], raw["source"], raw["fingerprint"], tables)
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError(f"could not parse {path}") from e


def spec_fingerprint(spec: Spec) -> str:
    """A checksum of the whole specification, to notice that it changed since a dump."""
    return hashlib.sha256(json.dumps(asdict(spec), sort_keys=True, default=str).encode()).hexdigest()


def run_jobs(jobs: Iterable[Callable], parallel: int = 8) -> list:
    """Submit independent Spark jobs side by side, so that small tables do not queue for large ones."""
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        return [f.result() for f in [pool.submit(inherit(j)) for j in jobs]]


def line_metrics(line: Column) -> dict[str, Column]:
    """Order-insensitive measures of a set of COPY lines: rows, bytes and two combined hashes."""
    h = F.when(line.isNotNull(), F.xxhash64(line))
    return {
        "rows": F.count(line),
        "bytes": F.coalesce(F.sum(F.octet_length(line).cast("bigint") + 1), F.lit(0)),
        "hash_xor": F.coalesce(F.bit_xor(h), F.lit(0).cast("bigint")),
        "hash_sum": F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string"),
    }


def digest_text(observed: dict) -> str:
    """The combined hash of observed :func:`line_metrics`."""
    return f"{observed['hash_xor'] & (2**64 - 1):016x}:{observed['hash_sum']}"


def _measured(lines: dict[str, DataFrame], columns: dict[str, list[str]]) -> DataFrame:
    """Measures of every table's lines, with one pre-aggregated shuffle for all tables."""
    parts = [df.select(F.lit(n).alias("table_name"), "value") for n, df in lines.items()]
    per_table = with_all_tables(parts, list(lines)).groupBy("table_name").agg(
        *[c.alias(n) for n, c in line_metrics(F.col("value")).items()]
    )
    digest = F.concat_ws(":", F.lower(F.lpad(F.hex("hash_xor"), 16, "0")), "hash_sum")
    names = per_name({n: F.array(*[F.lit(c) for c in cols]) for n, cols in columns.items()}, F.col("table_name"))
    return per_table.select("table_name", names.alias("columns"), "rows", "bytes", digest.alias("content_hash"))


def build_manifest(frames: Frames) -> DataFrame:
    """``(table_name, columns, rows, bytes, content_hash)`` of every table."""
    lines = {n: df.select(copy_line(df).alias("value")) for n, df in frames.items()}
    return _measured(lines, {n: df.columns for n, df in frames.items()})


def measure_dump(spark: SparkSession, folder: str, manifest: Manifest) -> DataFrame:
    """The manifest recomputed from the dumped lines themselves, without decoding them."""
    lines = {t.name: copy_lines(spark, f"{folder}/{t.file}") for t in manifest.tables}
    return _measured(lines, {t.name: t.columns for t in manifest.tables})


_MANIFEST_SCHEMA = "table_name string, columns array<string>, rows bigint, bytes bigint, content_hash string"


def manifest_frame(spark: SparkSession, manifest: Manifest) -> DataFrame:
    rows = [(t.name, t.columns, t.rows, t.bytes, t.content_hash) for t in manifest.tables]
    return spark.createDataFrame(rows, _MANIFEST_SCHEMA)


def compare_manifests(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Tables whose recorded and recomputed measures differ (S9); a table on one side only differs."""
    kept = ["rows", "bytes", "content_hash"]
    e = expected.select("table_name", *[F.col(c).alias(f"expected_{c}") for c in kept])
    a = actual.select("table_name", *[F.col(c).alias(f"actual_{c}") for c in kept])
    differs = F.lit(False)
    for c in kept:
        differs = differs | ~F.equal_null(F.col(f"expected_{c}"), F.col(f"actual_{c}"))
    return e.join(a, "table_name", "full_outer").where(differs)


def verify_manifest(frames: Frames, manifest: DataFrame) -> DataFrame:
    return compare_manifests(manifest, build_manifest(frames))


def verify_dump(spark: SparkSession, folder: str) -> DataFrame:
    manifest = load_manifest(spark, folder)
    return compare_manifests(manifest_frame(spark, manifest), measure_dump(spark, folder, manifest))


def export_copy(
    frames: Frames,
    folder: str,
    spec: Spec | None = None,
    skip: Iterable[str] = SYSTEM_SCHEMAS,
    source: str = "",
    parallel: int = 8,
    also_skip: Iterable[str] = (),
    compression: str | None = None,
) -> Manifest:
    """Dump tables as COPY text and write the manifest; rows and hashes are taken during the write (S3).

    Generated columns of ``spec`` and tables matching ``skip``, ``also_skip`` or the session's setting ``spark.rowkeel.alsoSkip`` (a list
    with commas: schemas of infrastructure, the history of migrations) stay out; a target folder that already holds something is
    refused. With a ``compression`` of Spark's text files (``gzip``) the dump is smaller, and is read again by as many tasks as wrote it;
    the recorded bytes and hashes are those of the lines.
    """
    spark = next(iter(frames.values())).sparkSession if frames else None
    left_out = [*skip, *also_skip, *also_skipped(spark)]
    names = [n for n in frames if not name_matches(n, left_out)]
    if not names:
        raise ValueError("no tables to dump")
    fs, p = hadoop_path(spark, folder)
    if fs.exists(p) and len(fs.listStatus(p)) > 0:
        raise FileExistsError(f"dump folder is not empty: {folder}")

    def one(name: str) -> DumpedTable:
        df = frames[name]
        if spec is not None and name in spec.tables:
            generated = [c.name for c in spec.tables[name].columns if c.generated is not None]
            df = df.drop(*generated)
        file = f"tables/{name}.copy"
        seen = Observation()
        lines = df.select(copy_line(df).alias("value"))
        measured = lines.observe(seen, *[c.alias(n) for n, c in line_metrics(F.col("value")).items()])
        measured.write.mode("errorifexists").text(f"{folder}/{file}", compression=compression, lineSep="\n")
        got = seen.get
        return DumpedTable(name, df.columns, got["rows"], got["bytes"], digest_text(got), file)

    tables = run_jobs([lambda n=n: one(n) for n in names], parallel)
    stamp = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    manifest = Manifest(stamp, source, spec_fingerprint(spec) if spec else None, tables)
    manifest.save(spark, folder)
    return manifest


def dump_lines(spark: SparkSession, folder: str, table: DumpedTable) -> DataFrame:
    """The raw lines of one dumped table."""
    path = f"{folder}/{table.file}"
    if not path_exists(spark, path):
        raise FileNotFoundError(f"a dump file listed in the manifest is missing: {table.file}")
    return copy_lines(spark, path)


def warn_on_fingerprint(manifest: Manifest, spec: Spec) -> bool:
    """Warn when the specification changed since the dump; the column intersection absorbs most drift."""
    changed = manifest.fingerprint is not None and manifest.fingerprint != spec_fingerprint(spec)
    if changed:
        warnings.warn("the specification has changed since this dump was taken", stacklevel=2)
    return changed

