"""Operator 5 - exact histogram of encoded document lengths.

Every whole text is encoded with a public tokenizer; only its length leaves the
task.  Documents are aggregated by length, and suffix sums over the distinct
lengths answer, for every context limit that makes a difference, how many
documents are longer, how many tokens there are in all, and how many are left
after truncation.  The suffix sums run over blocks of lengths and over the blocks'
totals, so no single task sees all lengths.

Special rows: null or empty text has length 0; repeated rows count each; an
empty table gives an empty histogram.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.llm import common as C

#: Place of the public vocabulary (byte-level BPE as ranks) and its pre-tokenization pattern.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Lengths in a block of the suffix sums.
BLOCK = 1024
_ENCODINGS: dict[tuple[str, str], object] = {}


def encoding(ranks_path: str, pattern: str):
    """The tokenizer, loaded once per Python worker."""
    import tiktoken

    if (ranks_path, pattern) not in _ENCODINGS:
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[ranks_path, pattern] = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[ranks_path, pattern]


def _lengths(ranks_path: str, pattern: str):
    def run(batches) -> Iterator[pa.RecordBatch]:
        encode = encoding(ranks_path, pattern).encode_ordinary
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(encode(x.as_py())) for x in batch.column(1)], pa.int64())],
                                             names=["_d", "n_tokens"])
    return run


def token_lengths(docs: DataFrame, ranks_path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """(_d, n_tokens) of every row."""
    return C.keyed(docs).select("_d", "text").mapInArrow(_lengths(ranks_path, pattern), "_d long, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """A row for each distinct length L, read as a context limit of L tokens.

    n_docs have the length, docs_longer are over the limit, tokens_total are in
    all texts, tokens_kept are left if every text is cut to L tokens, and
    ``quantile`` is the share of documents of at most L tokens.
    """
    hist = C.stored(lengths.groupBy(F.col("n_tokens").alias("length")).agg(F.count(F.lit(1)).alias("n_docs")), "lengths")
    hist = hist.withColumn("block", F.floor(F.col("length") / BLOCK)).withColumn("tokens", F.col("length") * F.col("n_docs"))
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    # one row for 1,024 lengths: a window over all of them is small
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(after), zero).alias("d_after"), F.coalesce(F.sum("t").over(after), zero).alias("t_after"),
                           F.sum("d").over(every).alias("d_all"), F.sum("t").over(every).alias("t_all"))
    inner = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    longer = F.coalesce(F.sum("n_docs").over(inner), zero) + F.col("d_after")
    beyond = F.coalesce(F.sum("tokens").over(inner), zero) + F.col("t_after")
    return (hist.join(blocks, "block").withColumn("docs_longer", longer).withColumn("beyond", beyond)
            .select("length", "n_docs", "docs_longer", F.col("t_all").alias("tokens_total"),
                    (F.col("t_all") - F.col("beyond") + F.col("length") * F.col("docs_longer")).alias("tokens_kept"),
                    ((F.col("d_all") - F.col("docs_longer")) / F.col("d_all")).alias("quantile")))


def at_limit(histogram: DataFrame, limit: int) -> DataFrame:
    """One row (docs_longer, tokens_kept) for any context limit, from the histogram alone."""
    return histogram.agg(
        F.coalesce(F.sum(F.when(F.col("length") > limit, F.col("n_docs"))), F.lit(0)).alias("docs_longer"),
        F.coalesce(F.sum(F.least("length", F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("tokens_kept"))


def op5_token_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(token_lengths(C.documents(spark, sf_dir)))
