"""Mixing sources to target weights, in DataFrame functions only.

The words of each source, its documents one after the other, are packed into blocks of ``BLOCK_WORDS``; a block is an index
into the source, so no text moves. The output is a row of slots, cut into shards. For each shard a multinomial draw says
how many slots each source gets; the whole parts of the expected counts are fixed and only what is left is drawn, which
keeps the expectation and takes most of the noise away. The slots of a source are numbered through all shards; number k is
mapped to a block by a pseudorandom permutation of the source's blocks, with another permutation for each pass through
the source. Joining slots with blocks by index says which words of which document are taken, and how often.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindle.llm.common import staged, text_or_empty

WEIGHTS = (1, 2, 3)
#: A source gives each of its words this often at most.
PASSES = 3
BLOCK_WORDS = 64
SHARD_SLOTS = 65_536
ROUNDS = 10
SEED = 17
#: Slots to a run, and to a task.
RUN_SLOTS, TASK_SLOTS = 4096, 100_000
#: Documents whose running sizes one task adds up.
BUCKET_ROWS = 100_000
#: Tables of sources up to this many rows are sent to all tasks.
FEW_SOURCES = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def words(text_column: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text_column), F.lit(WORD)).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """(source, sid, source_size, weight, target) from rows (source, size).

    Weights go round in the order of sources by code point, null last. Targets share the sum of all sizes by weight;
    they stop at PASSES times the source's size, and the excess goes to the others by weight, until none is above: in the
    order of limit by weight, the sources at their limit come first, and the first that stays below tells the share of
    one unit of weight for all after it.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sid = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.array(*map(F.lit, WEIGHTS))[(F.col("sid") - 1) % len(WEIGHTS)]
    ranked = staged(totals.withColumn("sid", sid).withColumn("weight", weight))
    before = Window.orderBy(F.col("source_size") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    rest = ranked.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    shares = ranked.crossJoin(F.broadcast(rest)).select(
        "*",
        (
            (F.col("all_size") - PASSES * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
            / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        ).alias("unit"),
    )
    limit = PASSES * F.col("source_size")
    below = shares.where(F.col("unit") * F.col("weight") <= limit)
    unit = below.agg(F.min(F.struct(F.col("source_size") / F.col("weight"), "sid", "unit")).alias("first")).select(F.col("first.unit").alias("unit"))
    made = ranked.crossJoin(F.broadcast(unit))
    target = F.least(limit.cast("double"), F.col("unit") * F.col("weight"))
    return made.select("source", "sid", "source_size", "weight", target.alias("target"))


def _with_source(sized: DataFrame, targets: DataFrame) -> DataFrame:
    small = targets.select(F.col("source").alias("of"), "sid", "source_size", "target")
    if targets.count() <= FEW_SOURCES:
        small = F.broadcast(small)
    return sized.join(small, sized["source"].eqNullSafe(small["of"])).drop("of")


def placed(sized: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``start``: the words of the same source before the row. Any source is cut into buckets of bounded size."""
    buckets = sized.count() // BUCKET_ROWS + 1
    dealt = sized.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    inside = Window.partitionBy("sid", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    bases = bases.select("sid", "bucket", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("base"))
    start = F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    return dealt.join(bases, ["sid", "bucket"]).withColumn("start", start).drop("bucket", "base")


def shard_counts(targets: DataFrame, block_words: int, shard_slots: int, seed: int) -> DataFrame:
    """(shard, sid, blocks, first, n): the slots a source gets in a shard, and the number of its first one there."""
    spark = targets.sparkSession
    blocks = F.ceil(F.col("source_size") / block_words)
    wanted = targets.where("source_size > 0").select("sid", blocks.alias("blocks"), (F.col("target") * blocks / F.col("source_size")).alias("slots"))
    row = wanted.agg(F.sort_array(F.collect_list(F.struct("sid", "blocks", "slots"))).alias("sources"), F.sum("slots").alias("total"))
    total = round(row.first()["total"] or 0)
    shards = spark.range(-(-total // shard_slots)).withColumnRenamed("id", "shard")
    size = F.least(F.lit(shard_slots), F.lit(total) - F.col("shard") * shard_slots)
    drawn = (
        shards.withColumn("m", size)
        .crossJoin(F.broadcast(row))  # one row
        .withColumn("mean", F.transform("sources", lambda s: F.col("m") * s["slots"] / F.col("total")))
        .withColumn("whole", F.transform("mean", lambda x: F.floor(x)))
        .withColumn("left", F.col("m") - F.aggregate("whole", F.lit(0).cast("long"), lambda a, x: a + x))
        .withColumn("part", F.zip_with("mean", "whole", lambda x, w: x - w))
        .withColumn("upto", F.expr("aggregate(part, array(0.0D), (a, x) -> concat(a, array(element_at(a, -1) + x)))"))
        .withColumn(
            "drawn",
            F.expr(
                f"""transform(if(left > 0, sequence(1L, left), array()), i -> least(size(part), size(filter(upto,
                u -> u <= element_at(upto, -1) * shiftrightunsigned(xxhash64({seed}, shard, i), 11) / 9007199254740992.0D))))"""
            ),
        )
        .withColumn("n", F.expr("transform(whole, (w, i) -> w + size(filter(drawn, d -> d = i + 1)))"))
        .select("shard", F.explode(F.arrays_zip("sources", "n")).alias("s"))
        .select("shard", "s.sources.sid", "s.sources.blocks", "s.n")
    )
    earlier = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return drawn.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0))).where("n > 0")


def permuted(index: str, size: str, key: str, rounds: int = ROUNDS) -> Column:
    """A permutation of 0 .. size - 1, chosen by ``key``: a swap-or-not shuffle, in which each round may swap an index with
    its mirror image around a random point; both ends of a swap see the same coin."""
    mirror = f"pmod(pmod(xxhash64({key}, r, 'point'), {size}) - a, {size})"
    return F.expr(f"aggregate(sequence(1, {rounds}), {index}, (a, r) -> if(xxhash64({key}, r, greatest(a, {mirror})) % 2 = 0, {mirror}, a))")


def slots(targets: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """(shard, slot, sid, block): what the mix takes, in the order of shards. No block is taken more than PASSES times."""
    counts = shard_counts(targets, block_words, shard_slots, seed)
    counts = staged(counts)
    # few rows make many slots: they are cut into runs first, and these dealt out to as many tasks as the slots need
    tasks = int(counts.agg(F.sum("n")).first()[0] or 0) // TASK_SLOTS + 1
    runs = counts.withColumn("from", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1, F.lit(RUN_SLOTS).cast("long"))))
    last = F.least(F.col("from") + RUN_SLOTS, F.col("first") + F.col("n")) - 1
    runs = runs.select("shard", "sid", "blocks", "from", last.alias("to")).repartition(tasks, "shard", "sid", "from")
    numbered = runs.select("shard", "sid", "blocks", F.explode(F.sequence("from", "to")).alias("slot"))
    numbered = numbered.where(F.col("slot") < PASSES * F.col("blocks"))
    passes = numbered.withColumn("pass", F.expr("slot div blocks")).withColumn("at", F.expr("slot % blocks"))
    return passes.select("shard", "slot", "sid", permuted("at", "blocks", f"{seed}, sid, pass").alias("block"))


def taken_parts(located: DataFrame, taken: DataFrame, keys: list[str], block_words: int = BLOCK_WORDS) -> DataFrame:
    """(*keys, from, to, n): word ranges of rows (keys, sid, start, size) that slots take ``n`` times."""
    used = taken.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("n"))
    first, last = F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}")
    cut = located.where("size > 0").select(*keys, "sid", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    low = F.greatest(F.col("block") * block_words, F.col("start")) - F.col("start")
    high = F.least((F.col("block") + 1) * block_words, F.col("start") + F.col("size")) - F.col("start")
    # the planner takes slots for few rows, as they come from few shards: they must not be sent to all tasks
    return cut.join(used.hint("merge"), ["sid", "block"]).select(*keys, low.alias("from"), high.alias("to"), "n")


def _located(docs: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows (keys, source, size, sid, source_size, target, start), written; and the table of sources."""
    sized = staged(docs.select(*keys, "source", words().alias("size"), *[F.xxhash64(text_or_empty()).alias("tie")] * ("tie" in order)))
    targets = staged(source_targets(sized))
    return staged(placed(_with_source(sized, targets), order)), targets


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target (its source's), taken.

    ``taken`` counts the words the mix takes from the document, repeats included: PASSES times its size at most. Null
    texts have size 0 and give nothing; null sources are a source, the last one. Rows that share an id are ordered by a
    hash of their text. An empty table, or one without words, gives nothing taken. Extra columns are ignored.
    """
    located, targets = _located(docs, ["doc_id"], ["doc_id", "tie"])
    parts = taken_parts(located, slots(targets, block_words, shard_slots, seed), ["sid", "start"], block_words)
    # words of a source start with one row each, so (sid, start) is the row; rows without words share a start
    taken = parts.groupBy("sid", "start").agg(F.sum((F.col("to") - F.col("from")) * F.col("n")).alias("taken"))
    columns = ["doc_id", "source", "size", "source_size", "target"]
    some = located.where("size > 0").join(taken, ["sid", "start"], "left").select(*columns, F.coalesce("taken", F.lit(0)).alias("taken"))
    return some.union(located.where("size = 0").select(*columns, F.lit(0).cast("long")))


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """The mix as documents, all columns kept: for c = 1 .. PASSES, each document with the words that are taken c times or
    more. Whole texts stay as they are; of others the words that are taken are joined by spaces. ``n_chars`` follows.

    Documents of which nothing is taken are not in the mix; texts without words never are. Rows that share an id are taken
    one by one, in the order of the table; rows equal in all columns are rows of their own. An empty table gives an empty mix.
    """
    kept = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")  # extra columns may have any name
    numbered = staged(docs.select(row, "doc_id", "source", "text").withColumn("row_number_", F.monotonically_increasing_id()))
    located, targets = _located(numbered, ["row_number_", "doc_id"], ["doc_id", "row_number_"])
    parts = taken_parts(located, slots(targets, block_words, shard_slots, seed), ["row_number_", "size"], block_words)
    copies = parts.select("row_number_", "size", "from", "to", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy_"))
    whole = copies.groupBy("row_number_", "copy_", "size").agg(
        F.sort_array(F.collect_list(F.struct("from", "to"))).alias("parts_"), F.sum(F.col("to") - F.col("from")).alias("sum_")
    )
    joined = numbered.join(whole, "row_number_")
    some = F.expr(
        f"""array_join(flatten(transform(array(regexp_extract_all(text, '{WORD}', 0)),
        w -> flatten(transform(parts_, p -> slice(w, cast(p.from + 1 as int), cast(p.to - p.from as int)))))), ' ')""".replace("\\", "\\\\")
    )
    made = joined.withColumn("text", F.when(F.col("sum_") == F.col("size"), F.col("text")).otherwise(some))
    made = made.withColumn("n_chars", F.length("text").cast("long"))
    return made.select(*[F.col(c) if c in ("text", "n_chars") else F.col(f"row.`{c}`") for c in kept])
