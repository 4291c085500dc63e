"""Mixing sources to target weights, with DataFrame operations only.

The words of each source, its documents in an order fixed by hash, are packed into blocks of fixed length. Targets
are shares by weight that stop at a multiple of the source's size. The mix is a row of output shards of equally many
slots, each slot for one block. A shard's counts by source are a multinomial draw at the targets' shares: every slot draws
its source. Sums of free draws miss the targets by their noise, and a source at its cap may not be taken once more, so draws
beyond a source's target, the last ones first, pass in order to the sources that lack as many; all others stand. Counts
summed over the shards before number a shard's slots within each source. A slot's number, carried through a keyed permutation
of that source's block indices (another for each pass), names the block, and blocks are joined by index; its place in the
shard is a keyed permutation too. Full passes take every block once; the last, partial pass takes full blocks
and at its end the start of one, so a source's taken words equal its rounded target.

Null and empty texts have no words and are never taken; null sources are one source, ordered last. Repeated rows are separate
documents, told apart by their place; rows that tie in the order by hash are ordered by id and size. A very long text is many
blocks. An empty table gives an empty result. sample() and written() return the columns of docs, whatever their names.
What grows with the sources only (a row for each) is ordered in one task; with shards, in a task for each source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import spill
from nearfield.llm.permute import permuted

WORD = r"[^\x20\x09-\x0D]+"
#: Slot numbers made from one row at a time.
STRIDE = 4096
#: Cells by which a number's range is found.
CELLS = 4096


def targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """sizes: (source, size) of documents. A row for each source: number, source_size, weight, target.

    Water filling: by rising most * size / weight, a source stops at its cap if that is below the level at which
    what is left, shared by the weights that are left, would put it.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    each = spill(each, "mix-sources").withColumn("number", F.row_number().over(order) - 1)
    each = each.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")))
    rising = Window.orderBy(F.col("source_size") / F.col("weight"), "number")
    before, onward = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    each = each.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    left = F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    each = each.withColumn("level", left / F.sum("weight").over(onward))
    each = each.withColumn("final", F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "number", "level"))).over(every)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap")))
    return spill(each.select("source", F.col("number").cast("long").alias("number"), "source_size", "weight", target.alias("target")), "mix-targets")


def placed(sized: DataFrame, keys: list[str], seed: str) -> DataFrame:
    """Adds start, the sum of sizes before a row among the rows of its keys, in an order by hash of doc_id.

    Two levels: sums of hash ranges, then sums within one, so no task sees a whole group.
    """
    ranges = 4 * int(sized.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.xxhash64(F.lit(seed), "doc_id", "size")
    rows = sized.withColumn("order", order).withColumn("range", F.shiftright((F.shiftright("order", 40) + (1 << 23)) * ranges, 24))
    sums = spill(rows.groupBy(*keys, "range").agg(F.sum("size").alias("words")), "mix-ranges")
    earlier = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = spill(sums.select(*keys, "range", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base")), "mix-bases")
    within = Window.partitionBy(*keys, "range").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(base, [*keys, "range"]).withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0))).drop("order", "range", "base")


def located(points: DataFrame, ranges: DataFrame, total: int) -> DataFrame:
    """Adds number to points: that of the range (number, first, length) that holds point. Ranges cover [0, total) and are
    found by equal cells of it."""
    cell = max(1, -(-total // CELLS))
    cells = ranges.filter("length > 0").select("number", "first", (F.col("first") + F.col("length")).alias("stop"), F.explode(F.expr(f"sequence(first div {cell}L, (first + length - 1) div {cell}L)")).alias("cell"))
    joined = points.withColumn("cell", F.expr(f"point div {cell}L")).join(spill(cells, "mix-cells"), "cell")
    return joined.filter("point >= first and point < stop").drop("cell", "first", "stop")


def _each(rows: DataFrame, count: str, name: str) -> DataFrame:
    """A row for each number from 0 to count - 1; dealt out by runs, as rows are few here and many below, which the planner can't see."""
    runs = spill(rows.select("*", F.explode(F.expr(f"sequence(0L, {count} - 1, {STRIDE}L)")).alias("run")), f"mix-{name}")
    runs = runs.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *[F.col(c) for c in ("number", "shard", "run") if c in runs.columns])
    return runs.withColumn(name, F.explode(F.expr(f"sequence(run, least(run + {STRIDE - 1}, {count} - 1))"))).drop("run")


def draws(plan: DataFrame, shard: int, seed: str) -> DataFrame:
    """plan: (number, slots) of sources. (shard, number, count): multinomial draws by shard, their sums pinned to slots."""
    order = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    p = spill(plan.select("number", "slots", F.coalesce(F.sum("slots").over(order), F.lit(0)).alias("first")), "mix-slots")
    total = p.agg(F.sum("slots")).first()[0] or 0
    if not total:
        return p.select(F.lit(0).cast("long").alias("shard"), "number", F.lit(0).cast("long").alias("count")).limit(0)
    every = _each(plan.sparkSession.range(1).select(F.lit(total).cast("long").alias("total")), "total", "slot")
    free = every.select(F.expr(f"slot div {shard}").alias("shard"), F.pmod(F.xxhash64(F.lit(f"{seed}-draw"), "slot"), F.lit(total)).alias("point"))
    drawn = located(free, p.select("number", "first", F.col("slots").alias("length")), total).groupBy("shard", "number").agg(F.count("*").alias("drawn"))
    drawn = spill(drawn, "mix-drawn")
    # what a source drew beyond its slots, in order of sources and shards, goes to what others lack, in order of sources
    sums = p.join(drawn.groupBy("number").agg(F.sum("drawn").alias("drawn")), "number", "left").withColumn("off", F.coalesce("drawn", F.lit(0)) - F.col("slots"))
    sums = sums.withColumns({"more": F.greatest(F.lit(0), "off"), "less": F.greatest(F.lit(0), -F.col("off"))})
    sums = spill(sums.select("number", "slots", "more", "less", F.coalesce(F.sum("more").over(order), F.lit(0)).alias("more_first"), F.coalesce(F.sum("less").over(order), F.lit(0)).alias("first")), "mix-sums")
    before = F.coalesce(F.sum("drawn").over(Window.partitionBy("number").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = drawn.join(sums.select("number", "slots", "more_first"), "number").withColumn("before", before)
    known = known.withColumn("count", F.greatest(F.lit(0), F.least("drawn", F.col("slots") - F.col("before"))))
    known = spill(known.select("shard", "number", "count", (F.col("drawn") - F.col("count")).alias("over"), (F.col("more_first") + F.greatest(F.lit(0), F.col("before") - F.col("slots"))).alias("over_first")), "mix-known")
    moving = known.filter("over > 0").select("shard", F.explode(F.expr("sequence(over_first, over_first + over - 1)")).alias("point"))
    moved = located(moving, sums.select("number", "first", F.col("less").alias("length")), max(1, sums.agg(F.sum("less")).first()[0]))
    counts = known.filter("count > 0").select("shard", "number", "count").union(moved.groupBy("shard", "number").agg(F.count("*").alias("count")).select("shard", "number", "count"))
    return spill(counts.groupBy("shard", "number").agg(F.sum("count").alias("count")), "mix-counts")


def slots(plan: DataFrame, block: int, shard: int, seed: str) -> DataFrame:
    """A row for each slot of the mix: number (of the source), pass, block, words (to take at most), shard, place."""
    words = F.round("target").cast("long")
    p = plan.filter("source_size > 0").withColumns({"want": words, "blocks": F.ceil(F.col("source_size") / block), "whole": F.expr(f"source_size div {block}")})
    p = p.withColumn("passes", F.expr("want div source_size")).withColumn("rest", F.col("want") % F.col("source_size"))
    p = p.withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block)).filter("slots > 0")
    p = spill(p.select("number", "blocks", "whole", "passes", "rest", "slots"), "mix-passes")
    counts = draws(p, shard, seed)
    before = lambda key, by: F.coalesce(F.sum("count").over(Window.partitionBy(key).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumns({"start": before("number", "shard"), "base": before("shard", "number"), "held": F.sum("count").over(Window.partitionBy("shard"))})
    s = _each(counts.join(p.drop("slots"), "number"), "count", "turn").withColumn("slot", F.col("start") + F.col("turn")).withColumn("dealt", F.col("base") + F.col("turn"))
    s = s.withColumn("pass", F.expr("slot div blocks")).withColumn("turn", F.col("slot") - F.col("pass") * F.col("blocks"))
    partial = F.col("pass") == F.col("passes")
    s = s.withColumn("range", F.when(partial, F.col("whole")).otherwise(F.col("blocks")))
    s = s.withColumn("tail", F.col("turn") >= F.col("range"))  # what is left of the partial pass once all full blocks are taken
    s = permuted(s, "index", F.when(F.col("tail"), F.lit(0)).otherwise(F.col("turn")), F.greatest(F.lit(1), F.col("range")), [F.lit(f"{seed}-block"), F.col("number"), F.col("pass")])
    s = permuted(s, "place", F.col("dealt"), F.col("held"), [F.lit(f"{seed}-place"), F.col("shard")])
    last = partial & (F.col("turn") == F.expr(f"rest div {block}"))
    return s.select(
        "number", "pass", F.when(F.col("tail"), F.col("whole")).otherwise(F.col("index")).alias("block"),
        F.when(last, F.col("rest") % block).otherwise(F.lit(block)).alias("words"), "shard", "place",
    )


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = 256, shard: int = 1 << 16, seed: str = "mix", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(documents, pieces). Documents: doc_id, key, size, source_size, target, number, start. Pieces: number, start (these two
    name the document), pass, shard, place, begin and length (in words of the document).

    key is a hash of id and text, for joining pieces back to texts.
    """
    rows = docs.select("doc_id", F.xxhash64("doc_id", text).alias("key"), F.col(source).alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = spill(rows, "mix-sizes")
    plan = targets(sized.select("source", "size"), weights, share, most)
    known = sized.join(plan.select(F.col("source").alias("source_"), "number", "source_size", "target"), F.col("source").eqNullSafe(F.col("source_"))).drop("source_", "source")
    found = spill(placed(known, ["number"], seed), "mix-documents")
    parts = found.filter("size > 0").select("number", "start", "size", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block"))
    at = F.col("block") * block
    parts = parts.withColumn("low", F.greatest("start", at) - at).withColumn("high", F.least(F.col("start") + F.col("size"), at + block) - at)
    taken = slots(plan, block, shard, seed).join(parts.hint("merge"), ["number", "block"]).withColumn("length", F.least("high", "words") - F.col("low")).filter("length > 0")
    return found, taken.select("number", "start", "pass", "shard", "place", (at + F.col("low") - F.col("start")).alias("begin"), "length")


def summary(found: DataFrame, pieces: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the first and last output shard that holds some of it, for each document."""
    sums = pieces.groupBy("number", "start").agg(F.sum("length").alias("got"), F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard"))
    sums = spill(sums, "mix-taken")
    joined = found.join(sums, (found.number == sums.number) & (found.start == sums.start) & (found["size"] > 0), "left")
    return joined.select("doc_id", found["size"], "source_size", "target", F.coalesce("got", F.lit(0)).cast("long").alias("taken"), "first_shard", "last_shard")


def written(docs: DataFrame, found: DataFrame, pieces: DataFrame, text: str = "text") -> DataFrame:
    """The output shards: a row for each piece with shard, place, begin and the columns of docs, text being the piece's words with the
    white space after each. By shard, place, number, start and begin it is the mix's order. Columns of docs with these names give way."""
    kept = [c for c in docs.columns if c not in ("shard", "place", "begin")]
    each = pieces.join(found.filter("size > 0").select("number", "start", "doc_id", "key"), ["number", "start"])
    each = spill(each.select(F.col("key").alias("_nf_id"), F.col("doc_id").alias("_nf_doc"), "shard", "place", "begin", "length"), "mix-written")
    texts = docs.select(*kept).withColumn("_nf_key", F.xxhash64("doc_id", text)).dropDuplicates(["doc_id", "_nf_key"]) if _repeats(found) else docs.select(*kept).withColumn("_nf_key", F.xxhash64("doc_id", text))
    rows = texts.join(each.hint("merge"), (F.col("_nf_key") == F.col("_nf_id")) & F.col("doc_id").eqNullSafe(F.col("_nf_doc")))
    words = F.regexp_extract_all(text, F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    rows = rows.withColumn(text, F.array_join(F.slice(words, (F.col("begin") + 1).cast("int"), F.col("length").cast("int")), ""))
    return rows.select("shard", "place", "begin", *kept)


def _repeats(found: DataFrame) -> bool:
    return bool(found.groupBy("doc_id", "key").count().filter("count > 1").head(1))


def sample(docs: DataFrame, found: DataFrame, pieces: DataFrame, text: str = "text") -> DataFrame:
    """The mixed documents with the columns of docs: a row for each document and pass, its taken words in order, with the white space after each."""
    each = pieces.groupBy("number", "start").agg(F.array_sort(F.collect_list(F.struct("pass", "begin", "length"))).alias("_nf_pieces"))
    each = each.join(found.filter("size > 0").select("number", "start", "doc_id", "key"), ["number", "start"])
    each = spill(each.select(F.col("key").alias("_nf_id"), F.col("doc_id").alias("_nf_doc"), "_nf_pieces"), "mix-pieces")
    texts = docs.withColumn("_nf_key", F.xxhash64("doc_id", text))
    if _repeats(found):
        texts = texts.dropDuplicates(["doc_id", "_nf_key"])
    words = F.regexp_extract_all(text, F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    rows = texts.join(each.hint("merge"), (F.col("_nf_key") == F.col("_nf_id")) & F.col("doc_id").eqNullSafe(F.col("_nf_doc"))).withColumn("_nf_words", words)
    rows = rows.withColumn("_nf_pass", F.explode(F.array_distinct(F.transform("_nf_pieces", lambda p: p["pass"]))))
    cut = F.array_join(F.flatten(F.transform(F.filter("_nf_pieces", lambda p: p["pass"] == F.col("_nf_pass")), lambda p: F.slice("_nf_words", (p["begin"] + 1).cast("int"), p["length"].cast("int")))), "")
    rows = rows.withColumn(text, cut)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)
