"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks of words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.postings import numbered
from ..session import materialize
from ..sizing import lookup_join

#: Words of a block, the unit that quotas count.
BLOCK = 32
#: Words that a shard of a source holds on average.
SHARD_WORDS = 1 << 17
#: A prime above any number of blocks of a shard; stepping by it visits each block once.
_STEP = 2**31 - 1


#: A word: a run of characters other than space, tab and line ends.
WORD = r"([^\x20\x09-\x0D]+)"


def words_of(text: Column) -> Column:
    """The words of a text, none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(1))


def targets(sources: DataFrame, weights: Sequence[float], share: float, limit: float) -> DataFrame:
    """Add ``target`` to ``(source, source_size)``: the weights' share of ``share`` times all words.

    Sources in order of code points, null last, take the weights in turn. No target is above ``limit``
    times its source; what a source can't take goes to the others by weight. Only the common factor is
    found on the driver, from two sums per round.
    """
    ranked = numbered(sources.withColumn("_null", F.col("source").isNull()), "_null", "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("n") % len(weights) + 1).cast("int"))
    ranked = materialize(ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(limit))).alias("most")), "weights")
    total = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    factor = 0.0
    while True:
        over = F.col("weight") * F.lit(factor) > F.col("most")
        full, open_weight = ranked.agg(F.sum(F.when(over, F.col("most"))), F.sum(F.when(~over, F.col("weight")))).first()
        if not open_weight:
            break
        new = (total - (full or 0.0)) / open_weight
        if new <= factor:
            break
        factor = new
    return ranked.select("source", "source_size", F.least("most", F.col("weight") * F.lit(factor)).alias("target"))


def sainte_lague(parties: DataFrame, votes: str, seats: str, group: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Add ``quota``: the seats of a group dealt one by one to the highest votes / (2 quota + 1).

    ``seats`` has the group's number of seats in each row. Two divisors give quotas that are certainly
    not too high and not too low; only the few seats between them, about two a party, are ranked.
    Without a group the ranking is a distributed sort.
    """
    half = F.col("_n") / 2
    rate = F.when(F.col("_votes") > 0, F.col(votes) / F.col("_votes")).otherwise(0.0)
    low = F.when(F.col(seats) > half, F.floor(rate * (F.col(seats) - half) + 0.5)).otherwise(0)
    high = F.greatest(F.floor(rate * (F.col(seats) + half) + 0.5) + 1, low)
    sums = parties.groupBy(*group).agg(F.sum(votes).alias("_votes"), F.count(F.lit(1)).alias("_n"))
    if group:
        both = _null_safe_join(parties, sums, group)
    else:
        row = sums.first()
        both = parties.withColumns({c: F.lit(row[c]) for c in ("_votes", "_n")})
    both = both.withColumn("_low", F.greatest(low, F.lit(0)).cast("long")).withColumn("_high", F.when(rate > 0, high).otherwise(F.lit(0)).cast("long"))
    both = materialize(both, "seats")
    quotient = (F.col(votes) / (2 * F.col("_seat") - 1)).desc()
    border = both.where("_high > _low").withColumn("_seat", F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))))
    if group:
        given = both.groupBy(*group).agg(F.sum("_low").alias("_given"))
        order = Window.partitionBy(*group).orderBy(quotient, *key)
        won = _null_safe_join(border, given, group).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= F.col(seats) - F.col("_given"))
    else:
        row = both.agg(F.max(seats), F.sum("_low")).first()
        won = border.orderBy(quotient, *key).limit(max(0, int((row[0] or 0) - (row[1] or 0))))
    more = won.groupBy(*key).agg(F.count(F.lit(1)).alias("_more"))
    out = _null_safe_join(both, more, key, "left")
    return out.withColumn("quota", F.col("_low") + F.coalesce("_more", F.lit(0))).drop("_votes", "_n", "_low", "_high", "_more")


def _null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns that may be null; the right side has one narrow row per key."""
    flags = [f"_null_{c}" for c in on]
    for c, f in zip(on, flags):
        left = left.withColumn(f, F.col(c).isNull()).withColumn(f"{f}_v", F.coalesce(F.col(c).cast("string"), F.lit("")))
        right = right.withColumn(f, F.col(c).isNull()).withColumn(f"{f}_v", F.coalesce(F.col(c).cast("string"), F.lit(""))).drop(c)
    keys = [*flags, *[f"{f}_v" for f in flags]]
    spread = next((c for c in ("_order", "_shard") if c in left.columns), None)
    return lookup_join(left, right, keys, how, spread_on=spread).drop(*keys)


def place(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    limit: float = 2.0,
    block: int = BLOCK,
    shard_words: int = SHARD_WORDS,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    carry: Sequence[str] = (),
) -> DataFrame:
    """``(doc_id, source, size, source_size, target, at, quota, blocks, first)`` and the ``carry`` columns.

    Each source is cut into shards by a seeded hash; a shard is a stream of words, its documents in a seeded
    order, cut into blocks of equal size. Blocks are dealt to sources, and then to the shards of a source, by
    Sainte-Lague. ``at`` is where the document begins in its shard, ``blocks`` the number of blocks there and
    ``quota`` how many are taken; ``first`` starts the seeded choice. See ``block_times``.

    A null or empty text has size 0. A null source is a source. Rows that are repeated are documents of their
    own. The result is the same in every run. An empty table gives no rows.
    """
    order = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(text_col))
    wide = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.size(words_of(F.col(text_col))).cast("long").alias("size"), order.alias("_order"), *[F.col(c).alias(f"_carry_{c}") for c in carry])
    narrow = materialize(wide.select("doc_id", "source", "size", "_order"), "sizes")
    sources = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    aimed = targets(sources, weights, share, limit)
    total = aimed.agg(F.sum("target")).first()[0] or 0.0
    aimed = aimed.withColumn("_seats", F.lit(round(total / block)))
    aimed = sainte_lague(aimed, "target", "_seats", [], ["source"]).withColumn("_shards", F.ceil(F.greatest(F.lit(1), F.col("source_size")) / F.lit(shard_words)))
    aimed = materialize(aimed.select("source", "source_size", "target", "_shards", F.col("quota").alias("_of_source")), "targets")

    def sharded(frame: DataFrame) -> DataFrame:
        return _null_safe_join(frame, aimed, ["source"]).withColumn("_shard", F.pmod(F.col("_order"), F.col("_shards")))

    shards = sharded(narrow).groupBy("source", "_shard").agg(F.sum("size").alias("_words"), F.first("_of_source").alias("_of_source"))
    shards = shards.withColumn("_votes_of", F.col("_words").cast("double"))
    shards = sainte_lague(shards, "_votes_of", "_of_source", ["source"], ["source", "_shard"])
    blocks = F.ceil(F.col("_words") / F.lit(block)).cast("long")
    shards = materialize(shards.select("source", "_shard", blocks.alias("blocks"), F.least("quota", blocks * F.lit(int(limit))).alias("quota")), "shards")
    before = Window.partitionBy("source", "_shard").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    frame = sharded(wide if carry else narrow).withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)))
    frame = _null_safe_join(frame, shards, ["source", "_shard"])
    first = F.xxhash64(F.lit(seed), F.col("source"), F.col("_shard"))
    return frame.withColumn("first", first).drop("_order", "_shard", "_shards", "_of_source")


def block_times(j: Column, quota: Column, blocks: Column, first: Column) -> Column:
    """How often block ``j`` of a shard is taken: all blocks equally often, and a seeded part once more."""
    rank = F.pmod(j * F.lit(_STEP) + F.pmod(first, blocks), blocks)
    return F.floor(quota / blocks) + F.when(rank < quota % blocks, 1).otherwise(0)


def mix(docs: DataFrame, block: int = BLOCK, **options) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)``: how many words of each document the mix takes."""
    placed = place(docs, block=block, **options)
    end = F.col("at") + F.col("size")

    def taken(total: Column, j: Column) -> Column:
        overlap = F.least(end, (j + 1) * block) - F.greatest(F.col("at"), j * block)
        return total + overlap * block_times(j, F.col("quota"), F.col("blocks"), F.col("first"))

    numbers = F.sequence(F.floor(F.col("at") / block), F.floor((end - 1) / block))
    sum_ = F.when(F.col("size") > 0, F.aggregate(numbers, F.lit(0).cast("long"), taken)).otherwise(F.lit(0).cast("long"))
    return placed.select("doc_id", "size", "source_size", "target", sum_.alias("taken"))


def take_mix(docs: DataFrame, block: int = BLOCK, limit: float = 2.0, text_col: str = "text", **options) -> DataFrame:
    """The documents of the mix, with all columns of ``docs``: a row for each time a document is taken.

    The text of a row has the words of the blocks taken in that pass, joined by one space; where all words are
    taken it is unchanged. Documents without a word that is taken are left out.
    """
    placed = place(docs, block=block, limit=limit, text_col=text_col, carry=docs.columns, **options)
    times = F.transform(
        F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.greatest("size", F.lit(1)) - 1) / block)),
        lambda j: block_times(j, F.col("quota"), F.col("blocks"), F.col("first")).cast("int"),
    )
    chosen = placed.where("size > 0").withColumn("_times", times).withColumn("_pass", F.explode(F.sequence(F.lit(1), F.lit(int(limit)))))
    chosen = chosen.where(F.array_max("_times") >= F.col("_pass"))
    text = F.col(f"_carry_{text_col}")
    taken = F.filter(words_of(text), lambda w, i: F.get("_times", F.floor((F.col("at") % block + i) / block).cast("int")) >= F.col("_pass"))
    part = F.when(F.array_min("_times") >= F.col("_pass"), text).otherwise(F.array_join(taken, " "))
    return chosen.select(*[(part if c == text_col else F.col(f"_carry_{c}")).alias(c) for c in docs.columns])
