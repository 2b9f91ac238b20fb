"""Near-duplicate names by character trigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowkeel.operators.change import assign_ids
from rowkeel.sources.staging import stage
from rowkeel.sources.tables import union_all


def trigrams(text: Column | str) -> Column:
    """The set of 3-grams of the lower-cased words, each padded with two blanks before and one after."""
    text = F.col(text) if isinstance(text, str) else text
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))

    def grams(word: Column) -> Column:
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words, grams)))


def trigram_pairs(df: DataFrame, text: str, threshold: float = 0.3, block: int = 2048) -> DataFrame:
    """Pairs of different names whose trigram sets overlap by at least ``threshold`` (Jaccard).

    Returns ``(name_a, name_b, similarity, copies_a, copies_b)`` with ``name_a < name_b``. Names are
    compared once each; rows sharing a name are counted, not paired. The result is exact:

    * in one order of all grams, two similar names share their first common gram within
      their prefixes, so only prefixes are joined, and a pair is emitted only at that gram;
    * the order puts the most frequent grams last, so they rarely reach a prefix;
    * a gram that still has more than ``block`` names is split into blocks, and each pair of blocks
      meets in its own join key; only pairs that pass the threshold leave the join.
    """
    names = _names(df, text)
    rows = _prefixes(_ordered(names, _ranks([names])), threshold)
    parts = _blocks(rows, block, "_parts")
    rows = rows.join(parts, "gram", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("name"), F.col("_parts")).cast("int"))
    # block i meets block j once, for i <= j
    a = _side(rows, "a", F.col("_own"), F.explode(F.sequence("_own", F.col("_parts") - 1)))
    b = _side(rows, "b", F.explode(F.sequence(F.lit(0), F.col("_own"))), F.col("_own"))
    once = (F.col("_i") < F.col("_j")) | (F.col("name_a") < F.col("name_b"))
    pairs = _matched(a, b, threshold, once)
    swap = F.col("name_a") > F.col("name_b")

    def placed(x: str, y: str) -> Column:
        return F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x)

    return pairs.select(
        placed("name_a", "name_b"),
        placed("name_b", "name_a"),
        "similarity",
        placed("copies_a", "copies_b"),
        placed("copies_b", "copies_a"),
    )


def trigram_lookup(
    batch: DataFrame, existing: DataFrame, text: str, threshold: float = 0.3, block: int = 2048
) -> DataFrame:
    """For each name of a batch the existing names that look like it, itself included.

    Returns ``(name, match, similarity, copies)``; ``copies`` counts the existing rows of the match.
    Exact, by the same means as :func:`trigram_pairs`.
    """
    left, right = _names(batch, text), _names(existing, text)
    ranks = _ranks([left, right])
    lrows = _prefixes(_ordered(left, ranks), threshold)
    rrows = _prefixes(_ordered(right, ranks), threshold)
    parts = _blocks(lrows, block, "_lp").join(_blocks(rrows, block, "_rp"), "gram", "full_outer")

    def split(rows: DataFrame, own: str) -> DataFrame:
        out = rows.join(parts, "gram", "left").withColumns(
            {"_lp": F.coalesce("_lp", F.lit(1)), "_rp": F.coalesce("_rp", F.lit(1))}
        )
        return out.withColumn("_own", F.pmod(F.xxhash64("name"), F.col(own)).cast("int"))

    a = _side(split(lrows, "_lp"), "a", F.col("_own"), F.explode(F.sequence(F.lit(0), F.col("_rp") - 1)))
    b = _side(split(rrows, "_rp"), "b", F.explode(F.sequence(F.lit(0), F.col("_lp") - 1)), F.col("_own"))
    pairs = _matched(a, b, threshold, F.lit(True))
    return pairs.select(
        F.col("name_a").alias("name"), F.col("name_b").alias("match"), "similarity", F.col("copies_b").alias("copies")
    )


def _names(df: DataFrame, text: str) -> DataFrame:
    """Distinct names with their row count and grams; names without a letter or digit have none."""
    names = (
        df.where(F.col(text).isNotNull())
        .groupBy(F.col(text).alias("name"))
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("grams", trigrams("name"))
    )
    return stage(names.where(F.size("grams") > 0), "names")


def _ranks(sides: list[DataFrame]) -> DataFrame:
    """``(gram, rank)``, rarest gram first; one row per distinct gram."""
    grams = union_all([side.select(F.explode("grams").alias("gram")) for side in sides])
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return assign_ids(counts, "rank", 1, ["n", "gram"]).select("gram", "rank")


def _ordered(names: DataFrame, ranks: DataFrame) -> DataFrame:
    """Gram sets as ascending ranks, so that numbers are compared in place of texts."""
    ranked = names.select("name", "copies", F.explode("grams").alias("gram")).join(ranks, "gram")
    sets = ranked.groupBy("name").agg(F.first("copies").alias("copies"), F.collect_list("rank").alias("grams"))
    return stage(sets.select("name", "copies", F.sort_array("grams").alias("grams")), "ranked-names")


def _prefixes(ordered: DataFrame, threshold: float) -> DataFrame:
    """One row per prefix gram with its place, carrying the whole gram set."""
    n = F.size("grams")
    # the tolerance keeps a product that should be whole from being rounded up
    keep = n - F.ceil(n * F.lit(threshold) - 1e-9).cast("int") + 1
    return ordered.select("name", "copies", "grams", F.posexplode(F.slice("grams", F.lit(1), keep)).alias("place", "gram"))


def _blocks(rows: DataFrame, block: int, name: str) -> DataFrame:
    """Grams with more than ``block`` rows and their number of blocks; at most rows / block of them."""
    crowded = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block)
    return stage(crowded.select("gram", F.ceil(F.col("_n") / block).cast("int").alias(name)), "crowded-grams")


def _side(rows: DataFrame, side: str, i: Column, j: Column) -> DataFrame:
    named = [F.col(c).alias(f"{c}_{side}") for c in ("name", "copies", "grams", "place")]
    return rows.select("gram", i.alias("_i"), j.alias("_j"), *named)


def _matched(a: DataFrame, b: DataFrame, threshold: float, allowed: Column) -> DataFrame:
    """Pairs meeting at their first common gram with enough grams in common.

    Sizes and places rule out most pairs before any set is intersected: from its first common gram on,
    a pair can share no more than what is left of the shorter rest. The intersection is a generator,
    so the optimizer computes it once per pair.
    """
    sa, sb = F.size("grams_a"), F.size("grams_b")
    needed = F.lit(threshold / (1 + threshold)) * (sa + sb) - 1e-9
    fits = (F.least(sa, sb) >= F.greatest(sa, sb) * threshold - 1e-9) & (
        F.least(sa - F.col("place_a"), sb - F.col("place_b")) >= needed
    )
    met = a.join(b, ["gram", "_i", "_j"]).where(allowed & fits)
    kept = ["gram", "name_a", "name_b", "copies_a", "copies_b", (sa + sb).alias("sizes")]
    common = met.select(*kept, F.explode(F.array(F.array_intersect("grams_a", "grams_b"))).alias("common"))
    shared = common.select(
        "name_a",
        "name_b",
        "copies_a",
        "copies_b",
        (F.get("common", F.lit(0)) == F.col("gram")).alias("first"),
        (F.size("common") / (F.col("sizes") - F.size("common"))).alias("ratio"),
    )
    return shared.where(F.col("first") & (F.col("ratio") >= threshold)).withColumn("similarity", F.round("ratio", 6))
