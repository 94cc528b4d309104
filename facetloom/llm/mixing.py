"""Mixing sources to target weights.

Words are counted per source; the weights and the share of all words give each
source a target, capped at a number of repeats of its words, and the excess goes to
the other sources by weight until none is above its cap.  ``target / size`` is the
repetition rate: each document is emitted ``floor(rate)`` times, and once more if a
hash of the seed, its source and its id falls below the fraction.

The shuffle carries one partial sum per source and task; a table of targets that was
measured and found small is broadcast, a larger one joined.  Targets come from a
few passes over the table of sources that return single numbers; sources themselves
are never collected.

Defined results: a null text has no words; a null source is a source of its own, the
last; a source without words has rate 0.  Rows with the same source and id share
their draw, so reruns and repeated rows agree.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, cut

#: Parameters of the registered query: weights in turn, share of all words, most repeats.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = 17
#: Bytes of a table of targets that may be broadcast; a larger one is joined by shuffle.
MAX_BROADCAST = 16 << 20


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with their place (from 0) by code point, null last, without one task that sorts all."""
    parts = cut(sources.sort(F.col("source").asc_nulls_last()).withColumn("id", F.monotonically_increasing_id()))
    counts = dict(parts.groupBy(F.shiftright("id", 33).alias("part")).count().collect())  # a row per partition
    before, so_far = [], 0
    for part in sorted(counts):
        before += [F.lit(part).cast("long"), F.lit(so_far).cast("long")]
        so_far += counts[part]
    first = F.create_map(*before)[F.shiftright("id", 33)] if before else F.lit(0).cast("long")
    return parts.withColumn("place", first + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))).drop("id")


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from rows of (source, size)."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    table = cut(ranked(sources).withColumn("weight", turn).withColumn("cap", F.col("source_size") * F.lit(float(most))))
    budget = (table.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = 0.0, -1
    while True:  # each pass caps at least one more source, or is the last
        full = F.col("cap") <= F.col("weight") * F.lit(level)
        n, used, left = table.agg(
            F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))
        ).first()
        if n == capped or not left:
            break
        level, capped = (budget - used) / left, n
    target = F.least("cap", F.col("weight") * F.lit(float(level)))
    return table.select("source", "source_size", target.alias("target"))


def draw(source: Column, doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from the seed, the source and the id."""
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(source, F.lit("")), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: int = SEED,
) -> DataFrame:
    """(row, size, source_size, target, copies): ``row`` is the input row, ``copies`` how often the mix takes it."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")
    sized = df.select(row, F.col(f"`{source_col}`").alias("source"), F.col(f"`{id_col}`").alias("id"), n_words(F.col(f"`{text_col}`")).alias("size"))
    targets = source_targets(sized.select("source", "size"), weights, share, most)
    targets = targets.withColumnRenamed("source", "of")
    n_bytes = targets.agg(F.sum(F.coalesce(F.octet_length(F.col("of").cast("string")), F.lit(0)) + 64)).first()[0] or 0
    if n_bytes <= MAX_BROADCAST:  # then texts stay where they are
        targets = F.broadcast(targets)
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col("of")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + (draw(F.col("source"), F.col("id"), seed) < rate - F.floor(rate)).cast("long")
    return joined.select("row", "size", "source_size", "target", copies.alias("copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """The mixed rows themselves: each input row as often as the mix takes it."""
    taken = mixed.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return taken.select("row.*")


ORACLE = f"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
a AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, {MOST} * source_size AS cap FROM a),
c AS (SELECT *, sum(cap) OVER o AS used, sum(weight) OVER () - sum(weight) OVER o AS left_w,
      lead(cap / weight) OVER (ORDER BY cap / weight, source) AS next_r
      FROM w WINDOW o AS (ORDER BY cap / weight, source ROWS UNBOUNDED PRECEDING)),
b AS (SELECT {SHARE} * sum(source_size) AS budget, sum(weight) AS all_w, min(cap / weight) AS first_r FROM w),
l AS (SELECT min(v) AS level FROM (
      SELECT budget / all_w AS v FROM b WHERE budget / all_w < first_r
      UNION ALL SELECT (budget - used) / left_w FROM c, b WHERE left_w > 0 AND (budget - used) / left_w < next_r AND (budget - used) / left_w >= cap / weight)),
t AS (SELECT source, source_size, least(cap, weight * level)::DOUBLE AS target FROM w, l),
r AS (SELECT s.doc_id, s.size, t.source_size, t.target, s.source, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  size * (floor(rate)::BIGINT + CASE WHEN ('0x' || substr(md5('{SEED}|' || coalesce(source, '') || '|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / {float(1 << 52)!r} < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM r"""
