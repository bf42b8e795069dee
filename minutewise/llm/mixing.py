"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame functions only.

1. Sources in the order of their code points, null last, take the weights in turn. Targets share the mix's words by
   weight; a source stops at `most` times its size and the excess is shared again, until none is above. Each round of that is
   one sum over the table of sources.
2. The mix has equal blocks of `block` words. Sources get blocks by the highest quotients target / (2 k + 1); each
   source's quota is shared out to its shards in the same way, with the shards' sizes as weights. Shards are drawn by a
   hash and hold about `shard` words, so that no source, however large, is ordered in one task.
3. In each shard the documents stand in a seeded order and are cut into blocks; the shard takes its quota from the
   front, all of it again (from the second block round on) where the quota is larger. A document's taken words are what
   of it lies in taken blocks.

Quotients are never listed: with D = sum of weights / seats, party i has floor(w / D + 1/2) seats at first. If that makes
x seats too many or too few in a group of m parties, party i gives or gets at most (x + m) w / sum + 1 seats more
(a divisor D' that settles it changes all parties by w times one number, up to 1 each), so only these quotients are
ranked: x + 3 m at most. A source is off its target by half a block at each of the two levels and shard, about.

Scale: texts are read once and only their sizes are written. Documents that can't be told apart in the result (equal id,
source and size) are counted first and stand in one row until the end, so no run of repeats is a task of its own. What one
task orders is the documents of a shard, a row a source (with at most 4 quotients), or a row a shard of one source.

Defined results: a null text has size 0; documents of size 0 are returned with 0 taken; a source of only such ones has the
target 0; null is a source of its own, not the same as an empty name; null or repeated ids are mixed row by row; ties go by
source, shard, and id; equal rows may be taken in different numbers, which rows is no matter as they are equal; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minutewise.functions.scalars import draw
from minutewise.llm.shared import BLANKS, staged, words

WEIGHTS = (5, 2, 1)
SEED = 20260916


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """sources (key, source, source_size): adds place, weight, target."""
    order = Window.orderBy(F.col("source").isNull(), "source")  # a row a source
    placed = sources.withColumn("place", (F.row_number().over(order) - 1).cast("long"))
    weighed = staged(placed.withColumn("weight", F.array(*map(F.lit, weights))[(F.col("place") % len(weights)).cast("int")].cast("double")), "sources")
    cap = F.col("source_size") * float(most)
    total = share * (weighed.agg(F.sum("source_size")).first()[0] or 0)
    # Sources that are full at one level stay full, so it only rises.
    level = 0.0
    while True:
        full = F.col("weight") * level >= cap
        at = weighed.agg(F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(~full, F.col("weight")).otherwise(0.0))).first()
        higher = (total - (at[0] or 0.0)) / at[1] if at[1] else level
        if higher <= level:
            break
        level = higher
    return weighed.withColumn("target", F.least(cap, F.col("weight") * level))


def apportion(parties: DataFrame, group: list[str], weight: str, seats: str, order: list[str], to: str) -> DataFrame:
    """Adds `to`: the party's seats of its group's `seats`, by the highest quotients weight / (2 k + 1); ties go by `order`.

    All parties of a group carry the same `seats`. Parties without weight get none."""
    whole = Window.partitionBy(*group)
    d = F.sum(weight).over(whole) / F.col(seats)
    fixed = parties.withColumn("_d", F.when((F.col(weight) > 0) & (F.col(seats) > 0), d))
    fixed = fixed.withColumn("_first", F.coalesce(F.floor(F.col(weight) / F.col("_d") + 0.5), F.lit(0)).cast("long"))
    fixed = fixed.withColumns({"_over": F.sum("_first").over(whole) - F.col(seats), "_m": F.count("*").over(whole), "_all": F.sum(weight).over(whole)})
    many = F.ceil((F.abs("_over") + F.col("_m")) * F.col(weight) / F.col("_all")).cast("long") + 1
    # The last seats of a group that has too many, the next ones of a group that has too few.
    last = F.sequence(F.greatest(F.lit(0), F.col("_first") - many).cast("long"), F.col("_first") - 1)
    following = F.sequence(F.col("_first"), F.col("_first") + many - 1)
    none = F.array().cast("array<long>")
    asked = F.when((F.col("_over") == 0) | F.col("_d").isNull(), none).when(F.col("_over") < 0, following).when(F.col("_first") > 0, last).otherwise(none)
    quotients = fixed.where(F.col("_over") != 0).select(*group, *order, "_over", weight, F.explode(asked).alias("_k")).withColumn("_q", F.col(weight) / (2 * F.col("_k") + 1))
    best = [F.desc("_q"), *map(F.asc, order)]
    worst = [F.asc("_q"), *map(F.desc, order)]
    rank = F.when(F.col("_over") < 0, F.row_number().over(whole.orderBy(*best))).otherwise(F.row_number().over(whole.orderBy(*worst)))
    changed = quotients.withColumn("_rank", rank).where(F.col("_rank") <= F.abs("_over"))
    change = changed.groupBy(*group, *order).agg(F.sum(F.when(F.col("_over") < 0, 1).otherwise(-1)).alias("_change"))
    return fixed.join(change, [*group, *order], "left").withColumn(to, F.col("_first") + F.coalesce("_change", F.lit(0))).select(*parties.columns, to)


def size_of(text: Column) -> Column:
    return F.size(words(text, BLANKS)).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, block: int = 16, shard: int = 500_000, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """doc_id, source, size, source_size, target, taken of each document; and the quotas: place, shard, words, quota."""
    key = F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("="), "source"))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size")).withColumn("key", key)
    units = staged(sized.groupBy("key", "source", "doc_id", "size").agg(F.count("*").alias("copies")), "sizes")
    sources = units.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    aimed = targets(sources, weights, share, most)
    whole = Window.partitionBy(F.lit(0))  # a row a source
    blocks = aimed.withColumns({"_group": F.lit(0), "_seats": F.round(F.sum("target").over(whole) / block).cast("long")})
    given = apportion(blocks, ["_group"], "target", "_seats", ["place"], "quota").drop("_group", "_seats", "source", "weight")
    given = staged(given.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard)).cast("long")), "quotas")

    hashed = draw(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size"))
    dealt = units.join(given.select("key", "place", "shards", "source_size", "target"), "key").withColumn("_h", hashed).withColumn("shard", F.col("_h") % F.col("shards"))
    held = dealt.groupBy("place", "shard").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    quotas = apportion(held.join(given.select("place", F.col("quota").alias("_of")), "place"), ["place"], "words", "_of", ["shard"], "quota").drop("_of")
    quotas = staged(quotas, "shard_quotas")

    line = Window.partitionBy("place", "shard").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_at", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(line), F.lit(0).cast("long")))
    one = placed.join(quotas, ["place", "shard"]).withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    take = F.least(F.col("quota") * block, F.col("words") * most)
    rounds = F.coalesce(F.floor(F.try_divide(take, F.col("words"))), F.lit(0)).cast("long")
    at = F.col("_at") + F.col("_copy") * F.col("size")
    taken = rounds * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), take - rounds * F.col("words") - at))
    return one.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken")), quotas


def mixing_query(docs: DataFrame) -> DataFrame:
    return mix(docs)[0].drop("source")


#: The same rows by listing all quotients.
MIXING_SQL = """WITH sz AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
so AS (SELECT *, [5.0, 2.0, 1.0][1 + place % 3] AS weight FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS place FROM sz GROUP BY source)),
ra AS (SELECT *, CAST(2 * source_size AS DOUBLE) AS cap, 2 * source_size / weight AS ratio FROM so),
lv AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio RANGE UNBOUNDED PRECEDING EXCLUDE GROUP), 0)) / sum(weight) OVER (ORDER BY ratio RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ra),
ll AS (SELECT arg_min(level, ratio) AS level FROM lv WHERE level <= ratio),
tg AS (SELECT s.*, least(cap, weight * (SELECT level FROM ll)) AS target FROM ra s),
n1 AS (SELECT *, CAST(round((SELECT sum(target) FROM tg) / 16) AS BIGINT) AS seats FROM tg),
q1 AS (SELECT place, target / (2 * k + 1) AS q, seats FROM (SELECT *, unnest(range(CAST(2 * target / 16 AS BIGINT) + 3)) AS k FROM n1)),
g1 AS (SELECT place, count(*) AS quota FROM (SELECT * FROM q1 WHERE q > 0 QUALIFY row_number() OVER (ORDER BY q DESC, place) <= seats) GROUP BY place),
hs AS (SELECT sz.*, place, source_size, target, CAST('0x' || substr(md5('20260916/' || coalesce(CAST(doc_id AS VARCHAR), '') || '/' || size), 1, 12) AS BIGINT) AS h, greatest(1, CAST(ceil(source_size / 500000) AS BIGINT)) AS shards FROM sz JOIN tg ON tg.source IS NOT DISTINCT FROM sz.source),
sh AS (SELECT place, h % shards AS shard, sum(size) AS words FROM hs GROUP BY ALL),
q2 AS (SELECT place, shard, words, words / (2 * k + 1) AS q, quota FROM (SELECT sh.*, quota, unnest(range(CAST(2 * quota * (words / sum(words) OVER (PARTITION BY place)) AS BIGINT) + 3)) AS k FROM sh JOIN g1 USING (place) WHERE words > 0)),
g2 AS (SELECT place, shard, any_value(words) AS words, count(*) AS quota FROM (SELECT * FROM q2 QUALIFY row_number() OVER (PARTITION BY place ORDER BY q DESC, shard) <= quota) GROUP BY ALL),
ln AS (SELECT hs.*, g2.words, coalesce(least(16 * g2.quota, 2 * g2.words), 0) AS take, sum(size) OVER (PARTITION BY hs.place, h % shards ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start FROM hs LEFT JOIN g2 ON g2.place = hs.place AND g2.shard = h % shards)
SELECT doc_id, size, source_size, target, CAST(coalesce(take // nullif(words, 0) * size + greatest(0, least(size, take % nullif(words, 0) - start)), 0) AS BIGINT) AS taken FROM ln"""
