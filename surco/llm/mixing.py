"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sources get targets by weight, none above `most` times its size. Quotas of
equal blocks of words go to sources by highest quotients target / (2k + 1), and
a source's quota goes to its shards in the same way by their words. In every
shard the documents lie in a seeded order; their words, cut into blocks, form a
ring, and the quota takes whole turns of the ring and a seeded run of blocks.
Everything is DataFrame functions; a shard holds at most about `shard_docs`
documents, so no window grows with a hot source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .words import WORD


def word_count(text: Column | str) -> Column:
    """Words of a text; null and empty have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: int = 3) -> DataFrame:
    """Target words per source from `source, source_size`; adds `target`.

    Sources in code point order, null last, take the weights in turn. The level
    at which the targets fill `share` of all words is found by going through the
    sources by the ratio at which each meets its bound: one row per source.
    A source of no words has the target 0. Without words every target is 0.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    rows = sizes.withColumn("weight", F.array(*map(F.lit, weights))[turn].cast("double"))
    rows = rows.withColumn("bound", (most * F.col("source_size")).cast("double"))
    by_bound = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_bound.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rows = rows.withColumn("all_words", share * F.sum("source_size").over(everything))
    rows = rows.withColumn("full", F.coalesce(F.sum("bound").over(before), F.lit(0.0)))
    rows = rows.withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    level = (F.col("all_words") - F.col("full")) / F.col("open")
    # Levels rise up to the first source that stays below its bound, and fall behind it.
    rows = rows.withColumn("level", F.max(level).over(everything))
    target = F.least("bound", F.col("level") * F.col("weight"))
    return rows.select("source", "source_size", target.alias("target"))


def apportion(parties: DataFrame, within: list[str], party: list[str], votes: str, seats: Column, cap: Column) -> DataFrame:
    """Seats by highest quotients votes / (2k + 1) within each group; adds `quota`.

    Only seats near a party's exact share can be in doubt, so quotients are
    compared for those: the seats below are safe, those above cannot be won.
    A party never gets more than `cap` seats. Ties go by the party's order.
    """
    group = Window.partitionBy(*within)
    rows = parties.withColumn("seats", seats.cast("long")).withColumn("cap", cap.cast("long"))
    total = F.sum(F.col(votes)).over(group)
    rows = rows.withColumn("exact", F.when(total > 0, F.col(votes) * F.col("seats") / total).otherwise(0.0))
    parties_here = F.count(F.lit(1)).over(group)
    # A divisor off by half a seat per party moves a party's seats by its share of that.
    doubt = F.ceil(F.when(total > 0, F.col(votes) / total).otherwise(0.0) * parties_here) + 1
    rows = rows.withColumn("safe", F.least("cap", F.greatest(F.lit(0), F.floor("exact") - doubt)))
    rows = rows.withColumn("last", F.least("cap", F.ceil("exact") + doubt))
    rows = rows.withColumn("left", F.col("seats") - F.sum("safe").over(group))
    keys = list(dict.fromkeys(within + party))
    claims = rows.filter("last > safe").select(*keys, votes, "left", F.explode(F.sequence("safe", F.col("last") - 1)).alias("seat"))
    claims = claims.filter(F.col(votes) > 0)
    order = Window.partitionBy(*within).orderBy((F.col(votes) / (2 * F.col("seat") + 1)).desc(), *[F.col(p).asc_nulls_last() for p in party], "seat")
    won = claims.withColumn("place", F.row_number().over(order)).filter("place <= left")
    won = won.groupBy(*[F.col(k).alias(f"won_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("won"))
    same = [F.col(k).eqNullSafe(F.col(f"won_{k}")) for k in keys]
    return rows.join(won, same, "left").select(*parties.columns, (F.col("safe") + F.coalesce("won", F.lit(0))).alias("quota"))


def mix(
    df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3),
    share: float = 1.0, most: int = 3, block: int = 16, shard_docs: int = 20_000, seed: int = 7, carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of `df`: key, source, size, source_size, target, taken, runs, and `carry` as a struct `carried`.

    `taken` counts the words that the mix takes from a document, repeats
    included: at most `most` times its size. `runs` are the words taken, as
    (first word, words) from 0, one whole run per repeat. Null texts and sources are allowed:
    a null text has no words, a null source is a source of its own. Rows with
    one key count as documents of their own; equal rows may swap their values.
    """
    docs = df.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
                     *([F.struct(*carry).alias("carried")] if carry else []))
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    shards = F.greatest(F.lit(1), F.ceil(F.col("docs") / shard_docs))
    plan = sizes.select("source", "source_size", shards.alias("shards"))
    aimed = targets(sizes.select("source", "source_size"), weights, share, most)
    blocks = F.round(F.sum("target").over(Window.partitionBy()) / block)
    quotas = apportion(
        aimed.withColumn("everywhere", F.lit(0)), ["everywhere"], ["source"], "target", blocks, F.ceil(most * F.col("source_size") / block)
    ).withColumnRenamed("quota", "source_quota").drop("everywhere")
    order = F.xxhash64(F.lit(seed), F.col("key"))
    docs = docs.withColumn("order", order)
    dealt = docs.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "source_size")
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("key")), F.col("shards"))).drop("shards")
    parts = dealt.groupBy("source", "shard").agg(F.sum("size").alias("words"))
    per = parts.join(quotas.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    per = per.withColumn("blocks", F.ceil(F.col("words") / block).cast("long"))
    won = apportion(per, ["source"], ["shard"], "words", F.col("source_quota"), most * F.col("blocks"))
    won = won.withColumnsRenamed({"source": "s", "shard": "h"})
    laid = dealt.withColumn("end", F.sum("size").over(Window.partitionBy("source", "shard").orderBy("order", "key", "size")
                                                      .rowsBetween(Window.unboundedPreceding, 0)))
    rows = laid.join(won, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("h")), "left").drop("s", "h")
    # Whole turns, then a run of blocks from a seeded one on, which may pass the ring's end.
    turns = F.when(F.col("blocks") > 0, F.floor(F.col("quota") / F.col("blocks"))).otherwise(0)
    first = F.when(F.col("blocks") > 0, F.pmod(F.xxhash64(F.lit(seed + 2), "source", "shard"), F.col("blocks"))).otherwise(0)
    rows = rows.withColumn("turns", turns).withColumn("first", first)
    rows = rows.withColumn("more", F.col("quota") - F.col("turns") * F.col("blocks"))
    begin, stop = F.col("end") - F.col("size"), F.col("end")

    def inside(low: Column, high: Column) -> Column:
        first = F.greatest(begin, low)
        return F.struct((first - begin).cast("long").alias("first"), F.greatest(F.lit(0), F.least(stop, high) - first).cast("long").alias("words"))

    low, high = F.col("first") * block, (F.col("first") + F.col("more")) * block
    ring_end = F.col("blocks") * block
    whole = F.struct(F.lit(0).cast("long").alias("first"), F.col("size").alias("words"))
    parts = F.array(inside(low, F.least(high, ring_end)), inside(F.lit(0), F.greatest(F.lit(0), high - ring_end)))
    runs = F.filter(F.concat(F.array_repeat(whole, F.coalesce("turns", F.lit(0)).cast("int")), parts), lambda x: x["words"] > 0)
    rows = rows.withColumn("runs", runs)
    taken = F.aggregate("runs", F.lit(0).cast("long"), lambda total, x: total + x["words"])
    return rows.select(
        F.col("key").alias(key), "source", "size", "source_size", "target", taken.alias("taken"), "runs", *(["carried"] if carry else []))


def mixed(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The rows of `df` as the mix takes them: one row per run, in the columns of `df`.

    A run of all words has the text as it is; a part has its words, joined by one
    space. Documents that the mix does not take are gone; so are texts without words.
    """
    rows = mix(df, key, text, source, carry=tuple(df.columns), **how)
    rows = rows.select("size", "carried", F.explode("runs").alias("run"))
    words = F.regexp_extract_all(F.col("carried")[text], F.lit(WORD), 0)
    part = F.array_join(F.slice(words, (F.col("run.first") + 1).cast("int"), F.col("run.words").cast("int")), " ")
    taken = F.when(F.col("run.words") == F.col("size"), F.col("carried")[text]).otherwise(part)
    return rows.select(*[(taken if c == text else F.col("carried")[c]).alias(c) for c in df.columns])
