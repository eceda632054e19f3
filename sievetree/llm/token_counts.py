"""Exact token counts by a length histogram.

Documents are encoded once, to their lengths. The histogram has a row for each distinct length, so everything behind it is as small
as the longest document is long. Suffix sums over it answer, exactly and for every context limit at once: how many documents and
tokens are at or over the limit, the total after truncation to it, and quantiles. The sums are taken in two steps, over blocks
of lengths and then inside each block, so that no window has to hold the whole histogram in one task.

Defined results: null and empty texts have length 0 and are counted; repeated rows are counted each time; an empty table gives an
empty histogram. Null values of a grouping column are a group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .bpe_columns import _default_path
from .common import written

BLOCK = 1024


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    codec = bpe.encoder(path)
    for batch in batches:
        all_texts = [t or "" for t in batch.column("text").to_pylist()]
        counts = [n for some in bpe.groups(all_texts) for n in codec.count(some)]
        yield batch.drop_columns(["text"]).append_column("n_tokens", pa.array(counts, pa.int64()))


def lengths(docs: DataFrame, by: Sequence[str] = (), path: str | None = None) -> DataFrame:
    """The columns `by`, renamed by0, by1 and so on, and n_tokens of each document."""
    path = path or _default_path()
    rows = docs.select(*[F.col(c).cast("string").alias(f"by{i}") for i, c in enumerate(by)], F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda b: _count(b, path), ", ".join([*(f"by{i} string" for i in range(len(by))), "n_tokens long"]))


def histogram(docs: DataFrame, by: Sequence[str] = (), path: str | None = None) -> DataFrame:
    """A row for each length (in each group): n_docs of it; docs_up_to; docs and tokens of at least it; truncated_tokens, the total if documents are cut to it; quantile, the share of documents up to it; and the totals."""
    group = [f"by{i}" for i in range(len(by))]
    # Read twice below, so it is written: texts are encoded once.
    hist = written(lengths(docs, by, path).groupBy(*group, "n_tokens").agg(F.count("*").alias("n_docs")), "token-histogram")
    hist = hist.withColumn("block", F.expr(f"n_tokens div {BLOCK}"))
    blocks = hist.groupBy(*group, "block").agg(F.sum("n_docs").alias("block_docs"), F.sum(F.expr("n_docs * n_tokens")).alias("block_tokens"))
    behind = Window.partitionBy(*group).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    blocks = blocks.select(
        *[F.col(g).alias(f"g_{g}") for g in group],
        F.col("block").alias("g_block"),
        F.coalesce(F.sum("block_docs").over(behind), F.lit(0)).alias("docs_behind"),
        F.coalesce(F.sum("block_tokens").over(behind), F.lit(0)).alias("tokens_behind"),
        F.sum("block_docs").over(whole).alias("total_docs"),
        F.sum("block_tokens").over(whole).alias("total_tokens"),
    )
    match = F.col("block") == F.col("g_block")
    for g in group:
        match = match & F.col(g).eqNullSafe(F.col(f"g_{g}"))
    inside = Window.partitionBy(*group, "block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    rows = hist.join(blocks, match).withColumn("docs_at_least", F.col("docs_behind") + F.sum("n_docs").over(inside)).withColumn("tokens_at_least", F.col("tokens_behind") + F.sum(F.expr("n_docs * n_tokens")).over(inside))
    up_to = F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")
    return rows.select(
        *[F.col(g).alias(c) for g, c in zip(group, by, strict=True)],
        "n_tokens",
        "n_docs",
        up_to.alias("docs_up_to"),
        "docs_at_least",
        "tokens_at_least",
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_tokens"),
        (up_to / F.col("total_docs")).alias("quantile"),
        "total_docs",
        "total_tokens",
    )


def limits(hist: DataFrame, context: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """For each context limit: documents and tokens at or over it, and the total truncated to it. Suffix sums fall with the length, so the one that counts is the largest of the lengths at or over the limit."""
    each = hist.withColumn("context", F.explode(F.array(*[F.lit(int(c)).cast("long") for c in context])))
    over = F.col("n_tokens") >= F.col("context")
    docs, tokens = F.coalesce(F.max(F.when(over, F.col("docs_at_least"))), F.lit(0)), F.coalesce(F.max(F.when(over, F.col("tokens_at_least"))), F.lit(0))
    out = each.groupBy(*by, "context").agg(docs.alias("docs_at_least"), tokens.alias("tokens_at_least"), F.first("total_docs").alias("total_docs"), F.first("total_tokens").alias("total_tokens"))
    return out.withColumn("truncated_tokens", F.expr("total_tokens - tokens_at_least + context * docs_at_least"))


def quantiles(hist: DataFrame, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """The smallest length that at least a share of the documents does not exceed."""
    each = hist.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    return each.where("docs_up_to >= share * total_docs").groupBy(*by, "share").agg(F.min("n_tokens").alias("n_tokens"))
