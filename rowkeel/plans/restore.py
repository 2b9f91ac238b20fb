"""Restoring a dump into a store (R3): select, load, conform, scrub, audit, publish."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rowkeel.functions.rows import name_matches
from rowkeel.operators.audit import audit_keys, audit_references
from rowkeel.operators.change import ScrubOutcome, ScrubRule, run_scrubs
from rowkeel.operators.conform import REASONS, align, annotate
from rowkeel.plans.store import Conflict, Store
from rowkeel.sources.copytext import text_columns
from rowkeel.sources.manifest import (
    DumpedTable,
    digest_text,
    dump_lines,
    line_metrics,
    load_manifest,
    run_jobs,
    warn_on_fingerprint,
)
from rowkeel.sources.staging import scratch_path, stage, stage_counted, write_small_text
from rowkeel.sources.tables import empty_frame
from rowkeel.spec import Frames

EXIT_OK, EXIT_REJECTED_ROWS, EXIT_ORPHANS, EXIT_DAMAGED, EXIT_CONFLICT = 0, 2, 4, 5, 6


@dataclass
class Loaded:
    table: str
    rows: int
    dropped: list[str]
    bad_rows: int = 0
    next_ids: dict[str, int] = field(default_factory=dict)
    quarantine: str | None = None


@dataclass
class RestoreReport:
    """What happened, in the terms of the receipt."""

    loaded: list[Loaded] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    missing: list[str] = field(default_factory=list)
    emptied: list[str] = field(default_factory=list)
    scrubs: list[ScrubOutcome] = field(default_factory=list)
    scrub_rules: list[str] = field(default_factory=list)
    orphans: list[dict] = field(default_factory=list)
    key_violations: list[dict] = field(default_factory=list)
    damaged: list[str] = field(default_factory=list)
    conflicts: list[str] = field(default_factory=list)
    specification_changed: bool = False
    published: bool = False
    exit_code: int = EXIT_OK

    def lines(self) -> list[tuple[str, str, int]]:
        out = [("loaded", t.table, t.rows) for t in self.loaded]
        out += [("rejected", t.table, t.bad_rows) for t in self.loaded if t.bad_rows]
        out += [("next_id", f"{t.table}.{c}", n) for t in self.loaded for c, n in t.next_ids.items()]
        out += [("excluded", n, 0) for n in self.excluded]
        out += [("missing", n, 0) for n in self.missing]
        out += [("emptied", n, 0) for n in self.emptied]
        out += [("scrubbed", f"{s.name}:{s.table}", s.affected) for s in self.scrubs]
        to = lambda o: o["parent"] or f"unknown type {o['parent_type']}"
        out += [("orphans", f"{o['child']}({o['child_columns']})->{to(o)}", o["orphan_rows"]) for o in self.orphans]
        out += [("bad keys", f"{k['table_name']}({k['key_columns']})", k["bad_rows"]) for k in self.key_violations]
        out += [("damaged", n, 0) for n in self.damaged]
        out += [("conflict", n, 0) for n in self.conflicts]
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.lines(), "kind string, name string, rows bigint")


def restore(
    spark: SparkSession,
    dump: str,
    store: Store,
    excludes: Sequence[str] = (),
    scrubs: Sequence[ScrubRule] = (),
    skip_scrub: bool = False,
    allow_orphans: bool = False,
    quarantine: bool = False,
    table_renames: dict[str, str] | None = None,
    column_renames: dict[str, dict[str, str]] | None = None,
    check_keys: bool = True,
    parallel: int = 8,
) -> RestoreReport:
    """Load a dump beside the current content and publish it if it passes.

    Each dumped table is read once: that pass checks the lines against the manifest, fits the rows
    to the specification, takes the id marks and writes the typed table. Loaded tables replace
    the current ones; tables that reference a loaded one and are not loaded themselves are
    emptied; other excluded tables keep their content. Rows that do not fit fail the load, or
    are set aside with their reasons under ``quarantine``. Orphans hold the publication back unless
    ``allow_orphans``. So does another writer who meanwhile changed a table that was loaded or that the audits read.
    """
    spec = store.spec
    base = store.version().number
    manifest = load_manifest(spark, dump).renamed(table_renames or {}, column_renames or {})
    report = RestoreReport(specification_changed=warn_on_fingerprint(manifest, spec))

    selected: list[DumpedTable] = []
    for t in manifest.tables:
        if name_matches(t.name, excludes):
            report.excluded.append(t.name)
            continue
        known = {c.name for c in spec.tables[t.name].stored_columns} if t.name in spec.tables else set()
        if known.intersection(t.columns):
            selected.append(t)
        else:
            report.missing.append(t.name)
    names = [t.name for t in selected]
    report.emptied = sorted(spec.referencing_closure(names))

    paths = {n: store.new_path(n) for n in names}
    loads = run_jobs([lambda t=t: _load(spark, dump, t, store, paths[t.name], quarantine) for t in selected], parallel)
    report.loaded = [result for result, _ in loads]
    report.damaged = [result.table for result, intact in loads if not intact]
    if report.damaged:
        return _finish(spark, store, report, EXIT_DAMAGED)
    if not quarantine and any(t.bad_rows for t in report.loaded):
        return _finish(spark, store, report, EXIT_REJECTED_ROWS)

    frames: Frames = store.frames(base)
    frames.update({n: empty_frame(spark, spec, n) for n in report.emptied})
    frames.update({n: store.open(n, p) for n, p in paths.items()})
    if check_keys:
        report.key_violations = [r.asDict() for r in audit_keys(frames, spec, names).collect()]
        if report.key_violations:
            return _finish(spark, store, report, EXIT_REJECTED_ROWS)

    if not skip_scrub:
        fresh: dict[str, str] = {}

        def place(name: str) -> str:
            fresh[name] = store.new_path(name)
            return fresh[name]

        frames, report.scrubs = run_scrubs(frames, scrubs, spec, place)
        report.scrub_rules = [r.name for r in scrubs]
        unknown = sorted(set(fresh) - set(spec.tables))
        if unknown:
            raise ValueError(f"clean-up rules made tables that the specification lacks: {unknown}")
        paths.update(fresh)

    # one row per violated key of the specification, and per unknown type
    report.orphans = [r.asDict() for r in audit_references(frames, spec, names).collect()]
    if report.orphans and not allow_orphans:
        return _finish(spark, store, report, EXIT_ORPHANS)
    marks = {t.table: t.next_ids for t in report.loaded if t.next_ids}
    written = set(paths) | set(report.emptied)
    linked = [{fk.child, fk.parent} for fk in spec.foreign_keys] + [{k.child, p} for k in spec.polymorphic_keys for _, p, _ in k.parents]
    audited = set().union(*(pair for pair in linked if written & pair))
    try:
        store.publish(paths, set(report.emptied) - set(paths), marks, base, audited, f"restore of {dump}")
    except Conflict as conflict:
        report.conflicts = conflict.tables
        return _finish(spark, store, report, EXIT_CONFLICT)
    report.published = True
    return _finish(spark, store, report, EXIT_OK)


def _load(spark, dump, t: DumpedTable, store: Store, path: str, quarantine: bool) -> tuple[Loaded, bool]:
    table = store.spec.tables[t.name]
    known = {c.name for c in table.stored_columns}
    kept = [c for c in t.columns if c in known]
    lines_seen, rows_seen = Observation(), Observation()
    lines = dump_lines(spark, dump, t)
    measured = lines.observe(lines_seen, *[c.alias(n) for n, c in line_metrics(F.col("value")).items()])

    def marked(source: DataFrame) -> DataFrame:
        aligned, _ = align(text_columns(source, t.columns, kept), table, generate=False)
        return annotate(aligned, table)

    good = F.size(REASONS) == 0
    ids = [c.name for c in table.columns if c.identity]
    watched = marked(measured).observe(
        rows_seen,
        F.count_if(good).alias("good_rows"),
        F.count_if(~good).alias("bad_rows"),
        *[F.max(F.when(good, F.col(c))).alias(f"top_{i}") for i, c in enumerate(ids)],
    )
    stage(watched.where(good).drop(REASONS), path=path)
    raw, got = lines_seen.get, rows_seen.get
    intact = (raw["rows"], raw["bytes"], digest_text(raw)) == (t.rows, t.bytes, t.content_hash)
    tops = {c: got[f"top_{i}"] for i, c in enumerate(ids)}
    result = Loaded(
        t.name,
        got["good_rows"],
        [c for c in t.columns if c not in known],
        got["bad_rows"],
        {c: 1 if top is None else max(top, 1) + 1 for c, top in tops.items()},
    )
    if quarantine and result.bad_rows:
        result.quarantine = scratch_path(spark, f"quarantine-{t.name}")
        stage_counted(marked(lines).where(~good).withColumnRenamed(REASONS, "reasons"), path=result.quarantine)
    return result, intact


def _finish(spark: SparkSession, store: Store, report: RestoreReport, code: int) -> RestoreReport:
    report.exit_code = code
    stamp = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S%fZ")
    write_small_text(spark, f"{store.root}/receipts/{stamp}-restore.json", json.dumps(asdict(report), indent=2))
    return report
