"""Mixing sources to target weights.

Words are added up per source; targets come from water-filling (a source never gets more than CAP times
its words, and what it can't take is dealt again among the others by weight); a source's repetition rate
is its target over its words. Each document is emitted floor(rate) times, and once more with probability
equal to the rate's fraction, drawn from a hash of seed and doc_id, so that reruns agree.

Defined results
---------------
* A null text has no words. The null source is a source of its own and comes last in the order.
* Rows of one doc_id share their draw, repeated rows included; null ids share one draw.
* A source without words has target 0 and no copies. An empty table gives an empty result.
* mix() adds size, source_size, target and copies (a column of docs with such a name is replaced); emit()
  returns the columns of docs as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import WORD, numbered, settle

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
SEED = "mix-1"


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """source, source_size, target: a row for each source; may be any number of sources."""
    sums = docs.groupBy("source").agg(F.sum(words()).alias("source_size"))
    placed = numbered(sums, [F.col("source").asc_nulls_last()])
    placed = settle(placed.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("position") % len(weights) + 1).cast("int"))), "sources")
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    left, weight, capped = share * total, None, -1
    over = F.lit(False)
    while True:  # each round one row comes back: how many sources are capped, their words, the others' weight
        now = placed.agg(F.sum(F.when(over, 1).otherwise(0)), F.sum(F.when(over, F.col("source_size")).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        if now[0] in (None, capped):
            break
        capped, left, weight = now[0], share * total - cap * (now[1] or 0), now[2]
        if not weight:
            break
        over = F.col("weight") * F.lit(float(left)) / F.lit(float(weight)) > cap * F.col("source_size")
    fair = F.col("weight") * F.lit(float(left)) / F.lit(float(weight or 1))
    return placed.select("source", "source_size", F.when(over, (cap * F.col("source_size")).cast("double")).otherwise(fair).alias("target"))


def draw(seed: str = SEED, doc_id: str = "doc_id") -> Column:
    """A number in [0, 1) from 52 bits of a hash."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """docs with size, source_size, target and copies."""
    own = ("size", "source_size", "target", "copies")
    goal = targets(docs, weights, share, cap).withColumnRenamed("source", "_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = docs.drop(*own).withColumn("size", words()).join(goal, F.col("source").eqNullSafe(F.col("_source")))
    return rows.withColumn("copies", (F.floor(rate) + F.when(draw(seed) < rate - F.floor(rate), 1).otherwise(0)).cast("long")).drop("_source")


def emit(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: rows with docs' columns, each as often as it is taken."""
    whole = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("row"))
    mixed = mix(whole, **how).filter("copies > 0")
    return mixed.withColumn("copy", F.explode(F.expr("array_repeat(1, cast(copies as int))"))).select("row.*")


def digest(docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS s FROM sized GROUP BY source
), placed AS (
  SELECT source, s, [3, 1, 2][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT] AS w FROM sums
), total AS (SELECT 1.5::DOUBLE * sum(s)::DOUBLE AS t FROM placed),
steps AS (
  SELECT source, s, w, 2.0 * s / w AS ratio,
         coalesce(sum(2 * s) OVER o, 0)::DOUBLE AS before, sum(w) OVER b AS rest, row_number() OVER (ORDER BY 2.0 * s / w, source NULLS LAST) AS k
  FROM placed
  WINDOW o AS (ORDER BY 2.0 * s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         b AS (ORDER BY 2.0 * s / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), level AS (
  SELECT k, (t - before)::DOUBLE AS fill, rest::DOUBLE AS rest FROM steps, total
  WHERE w * (t - before) / rest <= 2 * s ORDER BY k LIMIT 1
), goal AS (
  SELECT source, s, CASE WHEN steps.k < level.k THEN (2 * s)::DOUBLE ELSE w * fill / level.rest END AS target FROM steps, level
), drawn AS (
  SELECT d.doc_id, d.size, g.s, g.target, CASE WHEN g.s > 0 THEN g.target / g.s ELSE 0.0 END AS rate,
         ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM sized d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size::BIGINT AS size, s AS source_size, target,
       (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM drawn
"""
