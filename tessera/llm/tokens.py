"""Token ids of the public byte-level BPE, and exact length histograms.

The encoder takes the vocabulary's ranks; its ids are those of the same
vocabulary's JSON form under its default settings (a test holds them equal), so
``<|endoftext|>`` in a text is the one id of that added token.

Length histogram: documents are counted by encoded length within each task, the
counts are summed, and suffix sums over the distinct lengths answer totals,
quantiles and truncated totals of any context limit exactly.  The sums run in
two levels, blocks of lengths and lengths within a block, so no task gets all
distinct lengths.

Defined results: a null or empty text has no tokens; an empty table gives an
empty histogram; repeated rows count each time; further columns are ignored.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, slices

#: The added tokens of the JSON form, which the rank file lacks.
ADDED = {"<|endoftext|>": 50256}
#: Lengths that one block of the two-level sums holds.
BLOCK = 512


@cache
def encoder():
    import public_tokenizers
    import tiktoken

    lines = Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes().splitlines()
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED)


def encode(text: str) -> list[int]:
    return encoder().encode(text, allowed_special="all")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[int] = Counter()
    for batch in slices(batches):
        counts.update(len(encode(text)) for text in batch.column("text").to_pylist())
    if counts:
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["length", "docs"])


def length_histogram(docs: DataFrame) -> DataFrame:
    """length, docs: how many documents encode to each number of tokens."""
    return id_text(docs).select("text").mapInArrow(_counted, "length long, docs long").groupBy("length").agg(F.sum("docs").alias("docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each distinct length as a context limit: documents and tokens at or
    beyond it, documents up to it, and the tokens left if all are cut to it."""
    rows = histogram.withColumn("tokens", F.col("length") * F.col("docs")).withColumn("block", F.expr(f"length div {BLOCK}"))
    blocks = rows.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", *(F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_later") for c in "dt"), F.sum("d").over(Window.partitionBy()).alias("all_d"), F.sum("t").over(Window.partitionBy()).alias("all_t"))
    mine = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.join(blocks, "block").select(
        "length", "docs", "tokens", "all_d", "all_t", (F.sum("docs").over(mine) + F.col("d_later")).alias("docs_ge"), (F.sum("tokens").over(mine) + F.col("t_later")).alias("tokens_ge")
    )
    up_to = F.col("all_d") - F.col("docs_ge") + F.col("docs")
    return sums.select(
        "length", "docs", "tokens", "docs_ge", "tokens_ge", up_to.alias("docs_le"), (up_to / F.col("all_d")).alias("quantile"),
        (F.col("all_t") - F.col("tokens_ge") + F.col("length") * F.col("docs_ge")).alias("truncated_tokens"),
    )


def truncated_total(histogram: DataFrame, limit: int) -> int:
    """Tokens left if every document is cut to ``limit``, whatever the limit."""
    return histogram.agg(F.coalesce(F.sum(F.least("length", F.lit(limit)) * F.col("docs")), F.lit(0))).first()[0]


def quantile(sums: DataFrame, q: float) -> int | None:
    """The least length that a share ``q`` of the documents doesn't exceed."""
    return sums.filter(F.col("quantile") >= q).agg(F.min("length")).first()[0]


def token_bytes(text: str, end: int) -> bytes:
    """A document's ids and its end mark as little-endian unsigned 32-bit numbers."""
    return np.array([*encode(text), end], "<u4").tobytes()
