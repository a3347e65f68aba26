"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Every source gets a target: its weight's share of all words, stopped at `max_epochs` times its own size, the excess
   reshared by weight (water-filling, solved in closed form over the sources sorted by cap / weight).
2. A source's documents stand in a permuted order (hash of the id), cut into blocks of equal words. Its quota is a
   number of blocks: all of them for each full epoch, and in the last as many as the remainder needs.
3. A binary tree over the output shards splits the exact block quotas: the left half of a node draws a
   multivariate-hypergeometric part of every source's blocks, the right half keeps the rest. The leaves say how many
   blocks of each source a shard holds, and sum exactly to the quotas.
4. Each epoch's blocks are put in a random order of their own, and the shards draw from it one after the other, as many
   as their leaves say: disjoint permuted blocks. What a document is taken for follows from the drawn blocks that it
   lies in; documents are cut at block ends.
5. The pieces of a drawn block are shuffled locally (`place`), and a shard reads its draws in order.

All of it is DataFrame expressions. The tree has one row per node and arrays of one entry per source; the draws are a
table of at most BLOCKS blocks an epoch. Documents are ranked within hash buckets of a source and meet their blocks
in a join, so that a source with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import stored, whole_text, word_count

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SHARDS = 16
#: At most about so many blocks in an epoch of all sources: bounds the support of each hypergeometric draw.
BLOCKS = 65_536
LEAST_BLOCK_WORDS = 256
#: A node's arrays have an entry for each source; more sources than this are refused.
MOST_SOURCES = 4096
#: Documents of a source that are ranked together.
BUCKET_DOCS = 4096
SEED = 42


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, source_docs, target of each source; sources in code-point order, null last.

    The windows run over one row per source, not over documents.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    cap = (F.lit(max_epochs) * F.col("source_size")).cast("double")
    ranked = by_source.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))).withColumn("cap", cap)
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = ranked.withColumn("level", left / weight_left)
    return level.select("source", "source_size", "source_docs", F.least("cap", F.col("weight") * F.max("level").over(everything)).alias("target"))


def _gumbel(*keys: Column) -> Column:
    u = (F.xxhash64(F.lit(SEED), *keys).bitwiseAND(F.lit((1 << 52) - 1)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def _hypergeometric(marked: Column, total: Column, drawn: Column, *keys: Column) -> Column:
    """How many of `drawn` blocks out of `total` are among the `marked`: an exact draw, by the Gumbel-max rule over the support."""
    lo = F.greatest(F.lit(0).cast("long"), drawn - (total - marked))
    hi = F.least(marked, drawn)

    def seen(acc: Column, k: Column) -> Column:
        score = acc["logp"] + _gumbel(k, *keys)
        up = F.greatest((marked - k) * (drawn - k), F.lit(1)).cast("double") / ((k + 1) * F.greatest(total - marked - drawn + k + 1, F.lit(1))).cast("double")
        return F.struct((acc["logp"] + F.log(up)).alias("logp"), F.greatest(acc["best"], score).alias("best"), F.when(score > acc["best"], k).otherwise(acc["arg"]).alias("arg"))

    start = F.struct(F.lit(0.0).alias("logp"), F.lit(float("-inf")).alias("best"), lo.alias("arg"))
    return F.aggregate(F.sequence(lo, hi), start, seen, lambda acc: acc["arg"])


def _halved(node: DataFrame) -> DataFrame:
    """Both children of every node that holds more than one shard; counts: blocks of each source."""
    left_shards = F.floor(F.col("shards") / 2)
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    draw = F.floor(F.col("total") * F.col("left_shards") / F.col("shards"))

    def drawn(acc: Column, x: Column) -> Column:
        k = _hypergeometric(x, acc["total"], acc["n"], F.col("first"), F.col("shards"), F.size(acc["out"]))
        return F.struct((acc["total"] - x).alias("total"), (acc["n"] - k).alias("n"), F.concat(acc["out"], F.array(k)).alias("out"))

    start = F.struct(F.col("total").alias("total"), F.col("n").alias("n"), F.array().cast("array<bigint>").alias("out"))
    split = node.withColumn("left_shards", left_shards).withColumn("total", total).withColumn("n", draw).withColumn("left", F.aggregate("counts", start, drawn, lambda a: a["out"]))
    children = F.array(
        F.struct(F.col("first").alias("first"), F.col("left_shards").alias("shards"), F.col("left").alias("counts")),
        F.struct((F.col("first") + F.col("left_shards")).alias("first"), (F.col("shards") - F.col("left_shards")).alias("shards"), F.zip_with("counts", "left", lambda a, b: a - b).alias("counts")),
    )
    whole = F.array(F.struct("first", "shards", "counts"))
    return split.select(F.inline(F.when(F.col("shards") > 1, children).otherwise(whole)))


def splitting_tree(quotas: DataFrame, shards: int = SHARDS) -> DataFrame:
    """source, ends: the blocks of the source that shards 0..k hold together, for every k. quotas: source, blocks."""
    if quotas.count() > MOST_SOURCES:
        raise ValueError(f"the splitting tree takes at most {MOST_SOURCES} sources")
    root = quotas.agg(F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", "blocks"))).alias("all"))
    node = stored(root.select("all", F.lit(0).cast("long").alias("first"), F.lit(shards).cast("long").alias("shards"), F.transform("all", lambda s: s["blocks"]).alias("counts")))
    names = node.select("all")
    tree = node.select("first", "shards", "counts")
    for _ in range((shards - 1).bit_length()):
        tree = stored(_halved(tree))
    by_source = tree.select("first", F.posexplode("counts").alias("at", "blocks")).groupBy("at").agg(F.array_sort(F.collect_list(F.struct("first", "blocks"))).alias("shards"))
    ends = F.transform("shards", lambda x, i: F.aggregate(F.slice("shards", 1, i + 1), F.lit(0).cast("long"), lambda a, y: a + y["blocks"]))
    return names.select(F.posexplode("all").alias("at", "s")).join(by_source.select("at", ends.alias("ends")), "at").select("s.source", "ends")


def plan_blocks(targets: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Each source's row with quota (words), block_words, whole (blocks of full length), epochs, rest (words) and ends."""
    block_words = F.greatest(F.lit(LEAST_BLOCK_WORDS), F.ceil(F.sum("source_size").over(Window.partitionBy()) / BLOCKS))
    quotas = targets.withColumn("quota", F.round("target").cast("long")).withColumn("block_words", block_words)
    quotas = quotas.withColumns({"whole": F.floor(F.col("source_size") / F.col("block_words")), "all_blocks": F.ceil(F.col("source_size") / F.col("block_words"))})
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    quotas = quotas.withColumn("epochs", epochs).withColumn("rest", F.col("quota") - F.col("epochs") * F.col("source_size"))
    quotas = stored(quotas.withColumn("blocks", F.col("epochs") * F.col("all_blocks") + F.ceil(F.col("rest") / F.col("block_words"))))
    tree = splitting_tree(quotas.select("source", "blocks"), shards).withColumnRenamed("source", "of")
    return stored(quotas.join(tree, quotas["source"].eqNullSafe(tree["of"])).drop("of"))


def draw_blocks(plan: DataFrame) -> DataFrame:
    """source, epoch, block, draw, shard, words: every block drawn. draw: its place among the draws of its source.

    An epoch's blocks of full length come in random order, then the source's last block if it is shorter. The very
    last draw of a source is cut to what its quota leaves.
    """
    epochs = plan.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs"))).alias("epoch")).where((F.col("epoch") < F.col("epochs")) | (F.col("rest") > 0)).where("all_blocks > 0")
    every = epochs.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("all_blocks") - 1)).alias("block"))
    order = Window.partitionBy("source", "epoch").orderBy(F.col("block") >= F.col("whole"), F.xxhash64(F.lit(SEED + 2), "source", "epoch", "block"), "block")
    at = F.row_number().over(order) - 1
    length = F.least(F.col("block_words"), F.col("source_size") - F.col("block") * F.col("block_words"))
    drawn = every.withColumn("at", at).withColumn("words", F.when(F.col("epoch") < F.col("epochs"), length).otherwise(F.least(length, F.col("rest") - F.col("at") * F.col("block_words"))))
    draw = F.col("epoch") * F.col("all_blocks") + F.col("at")
    return drawn.where("words > 0").withColumn("draw", draw).select("source", "epoch", "block", "draw", F.size(F.filter("ends", lambda e: e <= F.col("draw"))).cast("int").alias("shard"), "words")


def _ranked(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """sizes with their source's plan and `before`: the words of the source that stand before the document."""
    own = plan.select(F.col("source").alias("from_source"), "source_size", "source_docs", "target", "block_words")
    dealt = sizes.join(own, sizes["source"].eqNullSafe(own["from_source"])).drop("from_source")
    order = F.xxhash64(F.lit(SEED), "doc_id", "source")
    dealt = dealt.withColumn("order", order).withColumn("bucket", F.pmod(F.shiftrightunsigned("order", 8), F.ceil(F.col("source_docs") / BUCKET_DOCS) + 8))
    sums = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    sums = sums.select(
        F.col("source").alias("in_source"), F.col("bucket").alias("in_bucket"),
        (F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("bucket_size")).alias("base"),
    )
    placed = dealt.join(sums, dealt["source"].eqNullSafe(sums["in_source"]) & (dealt["bucket"] == sums["in_bucket"])).drop("in_source", "in_bucket")
    running = F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("order", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return placed.withColumn("before", F.col("base") + running - F.col("size")).drop("base", "bucket")


def draw_pieces(sizes: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents with their place in their source, and row, shard, draw, place, start, words of every piece drawn.

    A piece is what a drawn block holds of a document: `words` words from word `start` of the document on. `place` is
    its rank in the block's local shuffle.
    """
    ranked = stored(_ranked(sizes, plan))
    first, last = F.floor(F.col("before") / F.col("block_words")), F.floor((F.col("before") + F.col("size") - 1) / F.col("block_words"))
    within = ranked.where("size > 0").select("row", "order", "source", "before", "size", "block_words", F.explode(F.sequence(first, last)).alias("block"))
    drawn = draw_blocks(plan).withColumnRenamed("source", "of").withColumnRenamed("block", "drawn")
    met = within.join(drawn, within["source"].eqNullSafe(drawn["of"]) & (within["block"] == drawn["drawn"]))
    block_start = F.col("block") * F.col("block_words")
    lo = F.greatest("before", block_start)
    words = F.least(F.col("before") + F.col("size"), block_start + F.col("words")) - lo
    pieces = met.select("row", "order", "source", "shard", "draw", (lo - F.col("before")).alias("start"), words.alias("words")).where("words > 0")
    local = Window.partitionBy("source", "draw").orderBy(F.xxhash64(F.lit(SEED + 1), "order", "start"), "row")
    return ranked, pieces.withColumn("place", (F.row_number().over(local) - 1).cast("long")).drop("order")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, shards: int = SHARDS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, pieces of every document, whatever other columns it has.

    `taken` counts the words drawn, repeats included: at most max_epochs * size, and over a source its target rounded
    to whole words. `pieces` says which words go where: an array of (shard, draw, place, start, words), empty if
    nothing is taken. Null text has size 0; a null source is a source of its own, the last. The draw depends on ids,
    sizes and sources only, so reruns agree; rows that repeat an id, size and source are drawn next to each other.
    An empty table gives no rows; more than MOST_SOURCES sources are refused.
    """
    own = docs.select("doc_id", "source", word_count(whole_text()).alias("size"))
    sizes = stored(own.withColumn("row", F.monotonically_increasing_id()))
    plan = plan_blocks(source_targets(sizes, weights, max_epochs), shards)
    ranked, pieces = draw_pieces(sizes, plan)
    drawn = pieces.groupBy("row").agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list(F.struct("shard", "draw", "place", "start", "words"))).alias("pieces"))
    none = F.array().cast("array<struct<shard:int,draw:bigint,place:bigint,start:bigint,words:bigint>>")
    return ranked.join(drawn, "row", "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), F.coalesce("pieces", none).alias("pieces")
    )


def write_shards(mixed: DataFrame, path: str) -> None:
    """Writes the pieces drawn, one directory a shard, draw after draw, each draw in its local shuffle's order."""
    pieces = mixed.select("doc_id", "source", F.inline("pieces"))
    pieces.repartition("shard", "draw").sortWithinPartitions("shard", "draw", "place").write.partitionBy("shard").parquet(path)
