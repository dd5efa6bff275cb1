"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

Every source has a weight. The mix is a multiple of all words, shared by weight; a source whose share would repeat its
words more than ``max_epochs`` times is clamped there, and the excess goes to the others by weight until none is above.
A source then gives whole repetitions of all its documents and, for the fraction that is left, the first documents in
a seeded order, the last of them in part, so that the words taken meet the target to within one word.

The sum over the seeded order is taken in two levels: 4,096 hash slots a source, then the documents within a slot.
A source with any share of the rows is therefore dealt over 4,096 groups, and only one number a slot and task is
shuffled before that.

Nulls: a null source is a source of its own, sorted last; a null text has no words; null ids are ordered as an empty
text. Repeated rows count as often as they occur. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.frames import SPACE, n_words, table, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
SLOT_DIGITS = 3  # hexadecimal digits of the seeded key that name a slot


def seeded_key(doc_id: str, seed: str = SEED) -> Column:
    """The place of a document in the seeded order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))


def source_targets(
    sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row per source.

    With the sources in the order in which they clamp (by cap over weight), the level of source j is what remains after
    clamping all before it, divided by the weights from it on. The level rises until the first source that does not
    clamp and falls after it, so the water level is the largest.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    by_ratio = Window.orderBy("ratio", F.asc_nulls_last("source"))
    everything = Window.partitionBy()
    ranked = (
        sources.withColumn("place", (F.row_number().over(by_name) - 1) % len(weights))
        .withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
    )
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = ranked.withColumn("level", (F.lit(float(share)) * F.col("total") - before) / onward)
    water = F.max("level").over(everything)
    return levels.select(
        "source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * water).alias("target")
    )


def mix_plan(
    sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """``(source, slot, source_size, target, whole, quota, before)`` from ``(source, slot, size)`` of every document.

    ``whole`` repetitions of everything leave ``quota`` words to take in seeded order, ``before`` of them lie in
    earlier slots.
    """
    slots = sizes.groupBy("source", "slot").agg(F.sum("size").alias("slot_size"))
    slots = written(slots, "mix-slots")
    targets = source_targets(
        slots.groupBy("source").agg(F.sum("slot_size").alias("source_size")), weights, share, max_epochs
    )
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    quota = F.round(F.col("target")).cast("long") - F.col("whole") * F.col("source_size")
    targets = targets.withColumn("whole", whole.cast("long")).withColumn("quota", quota)
    ahead = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("before", F.coalesce(F.sum("slot_size").over(ahead), F.lit(0)))
    same = slots["source"].eqNullSafe(targets["source"])
    joined = slots.join(targets, same).select(slots["source"], "slot", "source_size", "target", "whole", "quota",
                                              "before")
    return written(joined, "mix-plan")


def mix(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds ``source_size, target, taken`` to ``docs(source, slot, key, size, ...)``; ``taken`` counts repeats."""
    same = docs["source"].eqNullSafe(plan["source"]) & (docs["slot"] == plan["slot"])
    met = docs.join(plan, same).drop(plan["source"]).drop(plan["slot"])
    place = Window.partitionBy("source", "slot").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("before") + F.coalesce(F.sum("size").over(place), F.lit(0))
    extra = F.least(F.greatest(F.col("quota") - ahead, F.lit(0)), F.col("size"))
    return met.withColumn("taken", F.col("whole") * F.col("size") + extra).drop("whole", "quota", "before")


def with_slots(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Adds the seeded ``key`` and its ``slot``."""
    return docs.withColumn("key", seeded_key(doc_id)).withColumn("slot", F.substring("key", 1, SLOT_DIGITS))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document: ``doc_id, size, source_size, target, taken``."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", n_words("text").alias("size"))
    sized = written(with_slots(documents), "mix-sizes")
    mixed = mix(sized, mix_plan(sized.select("source", "slot", "size")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def mix_stage(docs: DataFrame) -> DataFrame:
    """The rows of the mix: the columns of ``docs`` with ``copy`` and ``words``, one row per repetition.

    A repetition in part keeps its first ``words`` words, joined by one space; a document of no words is kept once.
    """
    names = [c for c in docs.columns if c not in ("copy", "words")]
    carried = docs.select(F.struct(*names).alias("row"), "doc_id", "source", n_words("text").alias("size"))
    slotted = with_slots(carried)
    plan = mix_plan(written(slotted.select("source", "slot", "size"), "mix-sizes"))
    mixed = mix(slotted, plan)
    copies = F.greatest(F.ceil(F.col("taken") / F.col("size")), F.lit(0))
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(copies).cast("int")
    rows = mixed.where(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    words = F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size"))
    rows = rows.withColumn("words", F.greatest(words, F.lit(0)))
    parts = F.filter(F.split(F.col("row.text"), SPACE), lambda w: w != "")
    head = F.array_join(F.slice(parts, 1, F.col("words").cast("int")), " ")
    text = F.when(F.col("words") < F.col("size"), head).otherwise(F.col("row.text"))
    kept = [text.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names]
    return rows.select(*kept, "copy", "words")


ORACLE = {
    "op5_mix_sources": f"""
        WITH sized AS (
            SELECT doc_id, source, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
                   CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
            FROM documents),
        sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
        ranked AS (
            SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS weight,
                   source_size * 2 AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM sources),
        levels AS (
            SELECT *, (1.5::DOUBLE * total - coalesce(CAST(sum(cap) OVER (
                       ORDER BY cap::DOUBLE / weight, source NULLS LAST
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
                   / CAST(sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST
                       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level FROM ranked),
        targets AS (
            SELECT source, source_size, least(cap::DOUBLE, weight * max(level) OVER ()) AS target FROM levels),
        quotas AS (
            SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole
            FROM targets),
        placed AS (
            SELECT s.doc_id, s.size, q.source_size, q.target, q.whole,
                   CAST(round(q.target) AS BIGINT) - q.whole * q.source_size AS quota,
                   coalesce(CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.size
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS ahead
            FROM sized s JOIN quotas q ON s.source IS NOT DISTINCT FROM q.source)
        SELECT doc_id, size, source_size, target,
               CAST(whole * size + least(greatest(quota - ahead, 0), size) AS BIGINT) AS taken
        FROM placed
    """,
}
