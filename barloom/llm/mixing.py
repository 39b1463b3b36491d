"""Mixing sources to target weights, in DataFrame operations only.

1. The words of a source's documents, laid end to end in a fixed pseudorandom order, are cut into blocks of
   ``BLOCK_WORDS``. A document covers stretches of consecutive blocks.
2. The sources' targets follow from their weights; a source is used up to ``MAX_EPOCHS`` times, what it cannot take is
   shared among the others by weight.
3. Output shards of ``SHARD_BLOCKS`` slots draw their source counts from a multinomial distribution with the targets as
   weights: every slot draws one source from a hash of (seed, shard, slot). A source that came up more often over all
   shards than its quota of blocks gives its last draws to the sources that came up short, in order; about the square
   root of the number of draws changes hands, and every quota is met exactly.
4. The k-th slot of a source takes block ``permute(k mod blocks)`` of epoch ``k div blocks``: a bijection of the block
   numbers, different for each source and epoch, computed from the index alone. Slots join blocks by (source, index).

Scale: no window is keyed by source alone. Running totals go over chunks of rows and then over one row per chunk, so a
source with a third of all rows is spread like any other. Only the table with one row per source is ordered in one
place. Blocks, slots and words are never held as rows of the text.

Defined results: null texts have no words and are never taken; a null source is a source, the last one; rows with a null
or repeated ``doc_id`` are told apart by their place; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.stage import groups_for, stage

BLOCK_WORDS = 64
SHARD_BLOCKS = 1024
MAX_EPOCHS = 2
CHUNK_ROWS = 1 << 15
CELLS = 1 << 12
SLOTS_PER_TASK = 1 << 17
SWAP_ROUNDS = 8
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) to the same with ``weight`` and ``target``; one row per source.

    Where no source is above its limit, targets are in proportion to the weights. Sources reach their limit in the order
    of limit over weight, so the level of the others follows from running sums in that order.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    named = sizes.withColumn("nth", F.row_number().over(by_name) - 1)
    named = named.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod("nth", F.lit(len(weights))) + 1).cast("double"))
    named = named.withColumn("limit", F.col("source_size") * float(epochs)).withColumn("turn", F.col("limit") / F.col("weight"))
    whole = Window.partitionBy()
    earlier = Window.orderBy("turn", "nth").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) * share - F.coalesce(F.sum("limit").over(earlier), F.lit(0.0))
    rest = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    # The first source in that order whose limit is above the level that it and all later ones would share.
    levels = named.withColumn("level", left / rest).withColumn("level", F.when(F.col("turn") >= F.col("level"), F.col("level")))
    level = F.first("level", ignorenulls=True).over(Window.orderBy("turn", "nth").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    shared = levels.withColumn("target", F.coalesce(F.least(F.col("limit"), level * F.col("weight")), F.col("limit")))
    return shared.select("source", "source_size", "nth", "weight", "target")


def _running(df: DataFrame, keys: list[str], chunk: Column, order: list[str], amount: str, name: str) -> DataFrame:
    """Add the sum of ``amount`` over the earlier rows of the same keys, in the order (chunk, order)."""
    cut = df.withColumn("__chunk", chunk)
    totals = cut.groupBy(*keys, "__chunk").agg(F.sum(amount).alias("__total"))
    carried = totals.select(*keys, "__chunk", F.coalesce(F.sum("__total").over(Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__carry"))
    inside = F.coalesce(F.sum(amount).over(Window.partitionBy(*keys, "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cut.withColumn("__inside", inside).join(carried, [*keys, "__chunk"]).withColumn(name, F.col("__carry") + F.col("__inside")).drop("__chunk", "__carry", "__inside")


def permuted(df: DataFrame, index: str, size: str, *key: str, back: bool = False) -> DataFrame:
    """Replace ``index`` by its image under a pseudorandom bijection of [0, size), one for each key; ``back`` inverts it.

    A swap-or-not shuffle: every round pairs x with (shift - x) mod size and swaps the pair or not by a hash of its
    larger member. It works for any size without a table and without retries.
    """

    def turned(x: Column, turn: Column) -> Column:
        mate = F.pmod(F.pmod(F.xxhash64(*key, turn), F.col(size)) - x, F.col(size))
        swap = F.pmod(F.xxhash64(F.greatest(x, mate), *key, -turn), F.lit(2)) == 1
        return F.when(swap, mate).otherwise(x)

    # A fold keeps the expression small: written out, every round would repeat the one before several times.
    # Every round is its own inverse, so the rounds in reverse order undo them all.
    first, last = (SWAP_ROUNDS, 1) if back else (1, SWAP_ROUNDS)
    return df.withColumn(index, F.aggregate(F.sequence(F.lit(first), F.lit(last)), F.col(index).cast("long"), turned))


def quotas(sources: DataFrame, block_words: int, seed: int) -> DataFrame:
    """``sources`` with ``blocks`` and ``quota``: as many blocks as come nearest to the target, one at least.

    Whole epochs take every block. Of the last, partial epoch a prefix of its permutation is taken, and only the last block
    of a source is shorter; where it stands in that permutation tells whether the prefix holds it. So the words taken
    are within half a block of the target, or within one block of a target that is smaller than half a block.
    """
    cut = sources.withColumn("blocks", F.ceil(F.col("source_size") / block_words)).withColumn("epoch", F.expr("CAST(floor(target / source_size) AS BIGINT)"))
    cut = cut.withColumn("rest", F.col("target") - F.col("epoch") * F.col("source_size")).withColumn("missing", F.col("blocks") * block_words - F.col("source_size"))
    cut = permuted(cut.withColumn("seed", F.lit(seed)).withColumn("place", F.col("blocks") - 1), "place", "blocks", "nth", "epoch", "seed", back=True)
    without = F.round(F.col("rest") / block_words)
    part = F.when(without <= F.col("place"), without).otherwise(F.round((F.col("rest") + F.col("missing")) / block_words))
    quota = F.when(F.col("target") > 0, F.greatest(F.col("epoch") * F.col("blocks") + part.cast("long"), F.lit(1))).otherwise(0)
    return cut.withColumn("quota", F.coalesce(quota, F.lit(0)).cast("long")).drop("epoch", "rest", "missing", "seed", "place")


def slots(sources: DataFrame, total: int, shard_blocks: int, seed: int) -> DataFrame:
    """(shard, nth, epoch, block): what every slot of every output shard takes.

    ``sources`` has one row per source with ``nth``, ``blocks`` and ``quota``; ``total`` is the sum of the quotas.
    """
    width = max(1, -(-total // CELLS))
    before = F.coalesce(F.sum("quota").over(Window.orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = sources.filter("quota > 0").withColumn("low", before).withColumn("high", F.col("low") + F.col("quota"))
    cells = ranges.select("nth", "low", "high", F.explode(F.sequence(F.expr(f"low div {width}"), F.expr(f"(high - 1) div {width}"))).alias("cell"))

    # The draws. A source is found by the cell of the drawn number: cells are hit evenly, whatever the weights.
    drawn = sources.sparkSession.range(total).select(
        F.expr(f"id div {shard_blocks}").alias("shard"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(1, total))).alias("draw"))
    drawn = drawn.withColumn("cell", F.expr(f"draw div {width}")).join(cells, "cell").filter("draw >= low AND draw < high")
    counts = stage(drawn.groupBy("shard", "nth").agg(F.count(F.lit(1)).alias("n")))

    numbered = _running(counts, ["nth"], F.expr(f"shard div {CHUNK_ROWS}"), ["shard"], "n", "first")
    # A count stands for many slots: the counts are dealt out by the slots they stand for before these become rows.
    numbered = numbered.repartition(groups_for(total, SLOTS_PER_TASK), "shard").select("shard", "nth", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("k"))

    # Surplus draws of one source become the missing ones of another, matched by their running numbers.
    came = counts.groupBy("nth").agg(F.sum("n").alias("came"))
    account = sources.join(came, "nth", "left").withColumn("came", F.coalesce("came", F.lit(0)))
    account = account.withColumn("over", F.greatest(F.col("came") - F.col("quota"), F.lit(0))).withColumn("short", F.greatest(F.col("quota") - F.col("came"), F.lit(0)))
    order = Window.orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    account = stage(account.withColumn("over_before", F.coalesce(F.sum("over").over(order), F.lit(0))).withColumn("short_before", F.coalesce(F.sum("short").over(order), F.lit(0))))
    met = numbered.join(account.select("nth", "quota", "blocks", "over_before"), "nth")
    kept = met.filter("k < quota").select("shard", "nth", "k", "blocks")
    surplus = met.filter("k >= quota").select("shard", (F.col("over_before") + F.col("k") - F.col("quota")).alias("i"))
    missing = account.filter("short > 0").select("nth", "blocks", "short_before", "came", F.explode(F.sequence(F.lit(0).cast("long"), F.col("short") - 1)).alias("j"))
    missing = missing.select("nth", "blocks", (F.col("came") + F.col("j")).alias("k"), (F.col("short_before") + F.col("j")).alias("i"))
    every = kept.unionByName(surplus.join(missing, "i").select("shard", "nth", "k", "blocks"))
    every = every.select("shard", "nth", "blocks", F.expr("k div blocks").alias("epoch"), F.pmod("k", "blocks").alias("block"), F.lit(seed).alias("seed"))
    return permuted(every, "block", "blocks", "nth", "epoch", "seed").select("shard", "nth", "epoch", "block")


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, block_words: int = BLOCK_WORDS,
    shard_blocks: int = SHARD_BLOCKS, seed: int = 42, text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """Two tables: one row per row of ``docs`` (doc_id, tie, source, size, source_size, target, taken words), and the mix.

    The mix has one row per slot and document stretch: shard, source, epoch, block, doc_id, word_start and word_end
    (words of the document from 0, end exclusive). Rows of one block lie in one shard.
    """
    sized = stage(docs.select("doc_id", "source", word_count(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("tie")))
    planned = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share)
    sources = stage(quotas(planned, block_words, seed))
    total = int(sources.agg(F.sum("quota")).first()[0] or 0)

    chunks = groups_for(sized.count(), CHUNK_ROWS)
    known = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    words = _running(known.filter("size > 0"), ["nth"], F.pmod(F.xxhash64("doc_id", "tie"), F.lit(chunks)), ["doc_id", "size", "tie"], "size", "start")
    stretch = words.select("*", F.explode(F.expr(f"sequence(start div {block_words}, (start + size - 1) div {block_words})")).alias("block"))
    stretch = stretch.withColumn("word_start", F.greatest(F.col("block") * block_words - F.col("start"), F.lit(0)))
    stretch = stretch.withColumn("word_end", F.least((F.col("block") + 1) * block_words - F.col("start"), F.col("size")))

    taken_slots = slots(sources, total, shard_blocks, seed)
    times = taken_slots.groupBy("nth", "block").agg(F.count(F.lit(1)).alias("times"))
    shown = ["doc_id", "tie", "source", "size", "source_size", "target"]
    used = stretch.join(times, ["nth", "block"], "left").groupBy("nth", "start", *shown).agg(
        F.coalesce(F.sum((F.col("word_end") - F.col("word_start")) * F.col("times")), F.lit(0)).alias("taken"))
    empty = known.filter("size = 0").select(*shown, F.lit(0).cast("long").alias("taken"))
    per_document = used.select(*shown, "taken").unionByName(empty)
    mixed = taken_slots.join(stretch, ["nth", "block"]).select("shard", "source", "epoch", "block", "doc_id", "word_start", "word_end")
    return per_document, mixed


def mixed_documents(docs: DataFrame, text: str = "text", seed: int = 42, **options: object) -> DataFrame:
    """``docs`` as often as the mix takes them, as whole copies; other columns are kept, whatever their names.

    A document that the mix takes 1.4 times gives one copy, and its part of 0.4 of another is settled with the parts of
    its source's documents of about its size: their running total is rounded, so that copies and words taken differ
    by about one document of a source, and by no more than the sizes of one class differ for each ``CHUNK_ROWS`` rows beyond.
    Rows that are equal in id, source and text are settled together.
    """
    taken, _ = mix(docs, text=text, seed=seed, **options)
    alike = taken.groupBy("doc_id", "tie", "source").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size")).filter("taken > 0")
    # Parts in whole 2^20ths, so that their sums do not depend on the order of addition. Sizes of a class differ by a fifth.
    parts = alike.select("*", F.expr("taken div size").alias("whole"), F.expr(f"(taken % size) * {1 << 20} div size").alias("part"))
    parts = stage(parts.withColumn("class", F.floor(F.log2("size") * 4)))
    chunks = groups_for(parts.count(), CHUNK_ROWS)
    # Sources as structs, as a null source is one too and meets itself in a join.
    chunk = F.col("class") * chunks + F.pmod(F.xxhash64("doc_id", "tie"), F.lit(chunks))
    order = ["size", "doc_id", "tie"]
    totals = _running(parts.withColumn("named", F.struct("source")), ["named"], chunk, order, "part", "before")
    half = 1 << 19
    copies = F.col("whole") + F.expr(f"(before + part + {half}) div {1 << 20} - (before + {half}) div {1 << 20}")
    settled = totals.select("doc_id", "tie", "source", copies.cast("int").alias("copies")).filter("copies > 0")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.col("source").alias("from"), F.xxhash64(F.col(text)).alias("text_tie"))
    same = rows["id"].eqNullSafe(settled["doc_id"]) & rows["from"].eqNullSafe(settled["source"]) & (rows["text_tie"] == settled["tie"])
    return rows.join(settled, same).select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
