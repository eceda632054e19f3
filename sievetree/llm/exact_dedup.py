"""Exact deduplication through an extendible-hash index on shared files, in DataFrame operations only.

Texts are equal when identical after every ASCII white-space character is deleted. The index:

* Directory. It begins as one bucket of depth 0. A bucket over `capacity` distinct keys splits in two by the next bit of the 64-bit key,
  and so on until all fit; the directory doubles whenever the deepest bucket splits. Counts are taken `STEP` doublings at a time, so
  a pass over the keys serves that many. The directory is a table, one row for each bucket, never collected; depth ends where keys do.
* Owners. A row of documents goes to the task that owns its key's range (the leading bits that all buckets have), meets its bucket there,
  and is chained: rows of one bucket and key in order of their bytes, each compared with the one before it; another text under
  the same key gets the next place in the chain. Group sizes and the row that stays are found in the chain and written with it.
* Hot keys, of over `HOT` rows (the `HOT_KEYS` hottest, which bounds their broadcast; colder ones are chained row by row like all others),
  are counted up by text before they move, so a third of all rows with one text is a few rows to their owner. Their rows then probe
  the chain by key and SHA-256.

Texts move once, to their owner. Bucket files hold no text: key, place in the chain, SHA-256, group.

Defined results: a null text is the empty text; the empty text is a text like any other (all blank rows are one group). Ties in
code points go to the smallest doc_id, a null doc_id after all others. Rows that repeat an id and its text are each reported
(group_size counts them); where such a row is the one that stays, `kept` is true for all of them in `groups`, and `dedup` drops
the repetitions. An empty table gives an empty result. Columns other than doc_id and text are never read; `dedup` hands them on, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE, temporary, texts, written

CAPACITY, STEP = 2048, 8
HOT, HOT_KEYS = 256, 100_000
_ID_SPAN = 2**65


def _whole(x: int, digits: int) -> Column:
    return F.lit(str(x)).cast(f"decimal({digits},0)")


def normalised(text: Column) -> Column:
    for ch in ASCII_SPACE:
        text = F.replace(text, F.lit(ch), F.lit(""))
    return text


def _prefix(key: Column, depth: int) -> Column:
    """The leading bits of a key, as a number."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def _order(n_chars: Column, doc_id: Column) -> Column:
    """One number that is largest for the row that stays: code points first, then the smaller id, null last. (A decimal is updated in place by hash aggregation; a struct would force a sort on whole texts.)"""
    place = F.coalesce(_whole(2**63, 20) - doc_id.cast("decimal(20,0)"), _whole(0, 20))
    return (n_chars.cast("decimal(11,0)") * _whole(_ID_SPAN, 21) + place).cast("decimal(38,0)")


def _id_of(order: Column) -> Column:
    place = order % _whole(_ID_SPAN, 38)
    return F.when(place != 0, (_whole(2**63, 38) - place).cast("long"))


def _sha(norm: Column) -> Column:
    return F.sha2(norm.cast("binary"), 256)


def directory(keys: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(local_depth, bucket, n) of every bucket that holds a key, written; bucket: its leading local_depth bits. keys: one column key, no repeats."""
    keys = keys.select("key")
    n = keys.count()
    root = keys.sparkSession.range(1).select(F.lit(0).alias("local_depth"), F.lit(0).cast("long").alias("bucket"), F.lit(n).cast("long").alias("n"))
    if n <= capacity:
        return written(root.where("n > 0"), "exact-directory")
    rests, full = [], root
    for base in range(0, 64, STEP):
        cells = keys.select(_prefix(F.col("key"), base + STEP).alias("cell"), _prefix(F.col("key"), base).alias("bucket"))
        cells = cells.join(full.select("bucket"), "bucket", "left_semi").groupBy("cell").agg(F.count("*").alias("n"))
        levels = cells.select("n", "cell", F.explode(F.sequence(F.lit(base + 1), F.lit(base + STEP))).alias("local_depth"))
        levels = levels.groupBy("local_depth", F.expr(f"shiftrightunsigned(cell, {base + STEP} - local_depth)").alias("bucket")).agg(F.sum("n").alias("n"))
        levels = written(levels, "exact-levels")
        # Every bucket that is over its capacity is split; of the two, those that fit stay.
        over = full.select("local_depth", "bucket").unionByName(levels.where(F.col("n") > capacity).select("local_depth", "bucket"))
        halves = over.select((F.col("local_depth") + 1).alias("local_depth"), F.explode(F.array(F.col("bucket") * 2, F.col("bucket") * 2 + 1)).alias("bucket"))
        rests.append(levels.where(F.col("n") <= capacity).join(halves, ["local_depth", "bucket"], "left_semi").select("local_depth", "bucket", "n"))
        full = levels.where((F.col("local_depth") == base + STEP) & (F.col("n") > capacity))
        if full.isEmpty():
            break
    out = rests[0]
    for r in rests[1:]:
        out = out.unionByName(r)
    return written(out, "exact-directory")


def postings(docs: DataFrame, key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """A row for each document, without its text: (doc_id, key, sha); written."""
    rows = texts(docs).select("doc_id", normalised(F.col("text")).alias("norm"))
    return written(rows.select("doc_id", key(F.col("norm")).alias("key"), _sha(F.col("norm")).alias("sha")), "exact-postings")


def chained(rows: DataFrame) -> DataFrame:
    """rows (range, local_depth, bucket, key, norm, ...) with their place in the chain of their key: 1 for the first text under it, one more for each other one. Rows of a range are in one task."""
    own = Window.partitionBy("range", "local_depth", "bucket", "key").orderBy("norm")
    another = F.when(F.lag("norm").over(own).eqNullSafe(F.col("norm")), 0).otherwise(1)
    rows = rows.withColumn("another", another)
    return rows.withColumn("chain", F.sum("another").over(own.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("another")


def build_index(docs: DataFrame, post: DataFrame, capacity: int = CAPACITY, path: str | None = None, key: Callable[[Column], Column] = F.xxhash64, hot: int = HOT) -> DataFrame:
    """The bucket files: (local_depth, bucket, key, chain, sha, doc_id, counted, group_size, keep_id), a row for each document, but for hot keys one for each text (counted; doc_id null)."""
    counts = written(post.groupBy("key").agg(F.count("*").alias("n")), "exact-keys")
    cells = directory(counts, capacity)
    least = cells.agg(F.min("local_depth")).first()[0] or 0
    often = written(counts.where(F.col("n") > hot).orderBy(F.desc("n"), "key").limit(HOT_KEYS).select("key"), "exact-hot")
    rows = texts(docs).select("doc_id", F.length("text").alias("n_chars"), normalised(F.col("text")).alias("norm"))
    rows = rows.select("doc_id", key(F.col("norm")).alias("key"), "norm", _order(F.col("n_chars"), F.col("doc_id")).alias("ord"))
    single = rows.join(F.broadcast(often), "key", "left_anti").select("key", "norm", F.lit(1).cast("long").alias("n_rows"), "ord", "doc_id", F.lit(False).alias("counted"))
    if not often.isEmpty():
        several = rows.join(F.broadcast(often), "key", "left_semi").groupBy("key", "norm").agg(F.count("*").alias("n_rows"), F.max("ord").alias("ord"))
        single = single.unionByName(several.withColumns({"doc_id": F.lit(None).cast("long"), "counted": F.lit(True)}))
    # One task owns a range of keys, with all of its buckets; a bucket is found by the leading bits that are its own.
    owned = single.withColumn("range", _prefix(F.col("key"), least)).repartition("range")
    cells = cells.select(F.expr(f"shiftrightunsigned(bucket, local_depth - {least})").alias("range"), "local_depth", "bucket")
    inside = F.expr("if(local_depth = 0, 0L, shiftrightunsigned(key, 64 - local_depth))") == F.col("bucket")
    placed = chained(owned.join(cells, "range").where(inside))
    placed = placed.select("range", "local_depth", "bucket", "key", "chain", _sha(F.col("norm")).alias("sha"), "doc_id", "counted", "n_rows", "ord")
    group = Window.partitionBy("range", "local_depth", "bucket", "key", "chain")
    placed = placed.withColumns({"group_size": F.sum("n_rows").over(group), "keep_id": _id_of(F.max("ord").over(group))})
    return written(placed.drop("range", "n_rows", "ord"), "exact-index", path, kept=True)


def groups(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, key: Callable[[Column], Column] = F.xxhash64, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    post = postings(docs, key)
    with temporary(docs.sparkSession):
        index = build_index(docs, post, capacity, path, key, hot)
    names = ["doc_id", "keep_id", "group_size", "sha"]
    texts_of_hot = index.where("counted").select("key", "sha", "keep_id", "group_size")
    found = index.where("not counted").select(*names).unionByName(post.join(F.broadcast(texts_of_hot), ["key", "sha"]).select(*names))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def dedup(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of docs that stay, all columns. Of rows that repeat the id and the text that stay, one is kept."""
    with temporary(docs.sparkSession):
        stays = groups(docs, capacity).where("kept").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n"))
        stays = written(stays, "exact-kept", kept=True)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), _sha(normalised(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("sha"))
    match = lambda s: own.join(s.alias("s"), F.col("id").eqNullSafe(F.col("s.doc_id")) & (F.col("sha") == F.col("s.text_sha256")), "left_semi")
    once = match(stays.where("n = 1"))
    again = match(stays.where("n > 1")).dropDuplicates(["id", "sha"])
    return once.unionByName(again).select("row.*")
