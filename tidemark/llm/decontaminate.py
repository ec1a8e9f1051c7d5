"""Benchmark decontamination: a broadcast hash set of benchmark windows, probed by the windows of every document.

Only DataFrame functions: the words, their windows and the verification stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, without
from tidemark.session import cut_lineage

WINDOW = 13
#: Windows of the benchmark that are broadcast; a larger set is joined by a shuffle on the window's hash.
MAX_BROADCAST_WINDOWS = 200_000
#: Documents with possible hits whose ids are broadcast; beyond it the join shuffles.
MAX_BROADCAST_DOCS = 500_000
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text in order: ASCII letters (in lower case), digits and all characters past ASCII."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _NOT_WORD), "")


def _hashes(width: int) -> Column:
    """The hash of each run of `width` words, by position.

    The words are fetched one by one: slice() would copy the whole array for every position.
    """
    last = F.size("_words") - F.lit(width)
    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(width)]))
    return F.when(last >= 0, each).otherwise(F.array().cast("array<bigint>"))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per window of an item: width, hash, the words joined by blanks, item_id; an item without words has none."""
    items = benchmark.select("item_id", words(F.col("text")).alias("_words")).where(F.size("_words") > 0)
    width = F.least(F.lit(window), F.size("_words"))
    starts = F.sequence(F.lit(1), F.size("_words") - width + 1)
    rows = items.select("item_id", "_words", width.alias("width"), F.explode(starts).alias("start"))
    run = F.slice("_words", F.col("start"), F.col("width"))
    return rows.select("item_id", "width", F.xxhash64(run).alias("hash"), F.concat_ws(" ", run).alias("window")).distinct()


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """For every document its words, the words that lie in a benchmark window, and the items they come from.

    A word is hit if it lies inside an occurrence of a window; a window has `window` words, or all words of a shorter
    item. Null texts have no words. Rows that repeat a doc_id with its text are reported once. Without benchmark words
    nothing is hit. Columns other than doc_id and text (item_id and text of the benchmark) are ignored.

    Each document gives one row for itself and one number for each window; a window survives only if its hash is in
    the set, so what shuffles is about one small row per document. The few windows that are left are verified against
    the words of their documents, which are read again.
    """
    found = cut_lineage(item_windows(benchmark, window))
    sizes = sorted(r.width for r in found.select("width").distinct().collect())  # at most `window` numbers
    # Items that share a window meet in one row, so a document's window matches one row at most.
    keyed = found.groupBy("hash", "width", "window").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    hashes = found.select("hash").distinct()
    if found.count() <= MAX_BROADCAST_WINDOWS:
        keyed, hashes = F.broadcast(keyed), F.broadcast(hashes)
    base = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_key"), words(F.col("text")).alias("_words"))
    # Position 0 stands for the document; then come the windows of each width in turn. The outer form of explode keeps
    # the optimizer from testing the array's size first, which would compute the words anew for each window.
    own = F.array(F.lit(None).cast("bigint"))
    counted = base.select("doc_id", "_key", F.size("_words").alias("n_words"), F.concat(own, *[_hashes(n) for n in sizes]).alias("_all"))
    rows = counted.select("doc_id", "_key", "n_words", F.posexplode_outer("_all").alias("_at", "_hash"))
    rows = rows.join(hashes, rows["_hash"] == hashes["hash"], "left").where("_at = 0 or hash is not null")
    rows = cut_lineage(rows.select("doc_id", "_key", "n_words", "_at", "hash"))
    at, before, start, width = F.col("_at"), F.lit(1), F.lit(None).cast("int"), F.lit(None).cast("int")
    for n in sizes:
        count = F.greatest(F.lit(0), F.col("n_words") - n + 1)
        inside = (at >= before) & (at < before + count)
        start, width = F.when(inside, at - before).otherwise(start), F.when(inside, F.lit(n)).otherwise(width)
        before = before + count
    probed = rows.where("_at > 0").select("doc_id", "_key", "hash", start.alias("_start"), width.alias("width"))
    few = cut_lineage(probed.select(F.col("doc_id").alias("_id"), F.col("_key").alias("_k")).distinct())
    few = F.broadcast(few) if few.count() <= MAX_BROADCAST_DOCS else few
    of = base.join(few, base["doc_id"].eqNullSafe(few["_id"]) & (base["_key"] == few["_k"]), "left_semi").dropDuplicates(["doc_id", "_key"])
    wanted = probed.groupBy("doc_id", "_key").agg(F.collect_set(F.struct("_start", "width", "hash")).alias("_probes"))
    wanted = wanted.select(F.col("doc_id").alias("_id"), F.col("_key").alias("_k"), "_probes")
    of = of.join(wanted, of["doc_id"].eqNullSafe(wanted["_id"]) & (of["_key"] == wanted["_k"]))
    text = lambda p: F.concat_ws(" ", F.slice("_words", p["_start"] + 1, p["width"]))
    told = F.transform("_probes", lambda p: F.struct(p["_start"].alias("s"), p["width"].alias("w"), p["hash"].alias("h"), text(p).alias("t")))
    spans = of.select("doc_id", "_key", F.explode_outer(told).alias("p")).select("doc_id", "_key", "p.*")
    same = (spans["h"] == keyed["hash"]) & (spans["w"] == keyed["width"]) & (spans["t"] == keyed["window"])
    verified = spans.join(keyed, same).select("doc_id", "_key", F.struct("s", "w").alias("span"), "items")
    every = rows.where("_at = 0").select("doc_id", "_key", "n_words", F.lit(None).cast("struct<s:int,w:int>").alias("span"))
    every = every.withColumn("items", F.lit(None).cast("array<string>"))
    grouped = every.unionByName(verified.withColumn("n_words", F.lit(None).cast("int"))).groupBy("doc_id", "_key").agg(
        F.max("n_words").alias("n_words"),
        F.collect_set("span").alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x["s"], x["s"] + x["w"] - 1))))
    n_hit = F.size(covered).cast("long")
    return grouped.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.sort_array("items")), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.sort_array("spans").alias("spans"),
        "_key",
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` without the documents of which at least a twentieth of the words is hit; all columns stay."""
    rejected = hits(docs, benchmark, window).where("contaminated")
    return without(docs, rejected, F.xxhash64(F.coalesce("text", F.lit(""))))
