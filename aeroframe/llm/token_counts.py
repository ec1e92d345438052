"""Token counts through a cache of digests.

A count depends on the content and on the tokenizer alone, so both are named by a
digest: that of the text, and that of the vocabulary file and library version. The
cache is a Parquet table partitioned by tokenizer version. Digests of the corpus are
joined to it; of those it lacks each text is encoded once, whatever its copies, and
appended. No text moves but those of misses.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c
from . import segments

CACHE_SCHEMA = "digest binary, n_tokens long, version string"
#: Missing digests (32 bytes each) that are sent to all executors at most; more of them meet the texts in a shuffle.
FEW = 200_000


def tokenizer_version(path: str) -> str:
    """Digest of all that a count depends on beside the text: the vocabulary file, the library's version and its settings."""
    import tokenizers

    state = hashlib.sha256(f"tokenizers {tokenizers.__version__} add_special_tokens=False truncation=None padding=None\n".encode())
    with open(path, "rb") as f:
        for block in iter(lambda: f.read(1 << 20), b""):
            state.update(block)
    return state.hexdigest()


def digest(text: str = "text"):
    """The digest of a text's content. A null is the empty text; nothing else is normalised, since bytes decide the tokens."""
    return F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256))


class CountCache:
    """Counts of digests in a folder that driver and executors share.

    Each append is one Spark write, which commits whole or not at all. Two jobs that miss
    the same digest both append it; reading keeps one row of each.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").partitionBy("version").parquet(path)

    def counts(self, version: str) -> DataFrame:
        """(digest, n_tokens) of one tokenizer version; other versions' folders are not read."""
        rows = self.spark.read.schema(CACHE_SCHEMA).parquet(self.path).where(F.col("version") == version)
        return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def append(self, rows: DataFrame, version: str) -> None:
        rows.select("digest", "n_tokens", F.lit(version).alias("version")).write.mode("append").partitionBy("version").parquet(self.path)


def missing_texts(texts: DataFrame, misses: DataFrame) -> DataFrame:
    """One text of each digest in ``misses``. ``texts``: (digest, text).

    Copies are dropped in each task before any text is shuffled. Few misses, as with a warm
    cache, are broadcast, so that no other text is shuffled at all.
    """
    if c.small_enough(misses, FEW):
        return texts.join(F.broadcast(misses), "digest", "left_semi").dropDuplicates(["digest"])
    return texts.dropDuplicates(["digest"]).join(misses, "digest", "left_semi")


def encode_counts(texts: DataFrame, tokenizer: str) -> DataFrame:
    """(digest, n_tokens) of each row of (digest, text), encoded whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = segments.library_encoder(tokenizer, segments.cut_before_space)
        for batch in c.tidy(batches):
            for piece in c.slices(batch, most=segments.SLICE_BYTES):
                _, offsets = encoder(c.text_column(piece, "text"))
                yield pa.record_batch({"digest": piece.column("digest"), "n_tokens": np.diff(offsets)})

    return texts.mapInArrow(run, "digest binary, n_tokens long")


def token_counts(documents: DataFrame, tokenizer: str, cache: CountCache, limit: int = 512) -> DataFrame:
    """Per row of ``documents``: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A null text is the empty one, with no token; texts of any length are encoded whole.
    Rows that repeat a doc_id, and those without one, each give a row. Special strings in a
    text count as the library counts them by default. An empty table gives no row and leaves
    the cache as it was; other columns are ignored, whatever their names.
    """
    version = tokenizer_version(tokenizer)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # digests once: 32 bytes a row stand for the text in all that follows
    keys = c.stash(documents.select(F.col("doc_id").cast("long"), F.octet_length(text).cast("long").alias("n_bytes"), digest().alias("digest")), "digests")
    misses = c.stash(keys.select("digest").distinct().join(cache.counts(version), "digest", "left_anti"), "misses")
    if misses.limit(1).count():
        texts = documents.select(digest().alias("digest"), text.alias("text"))
        cache.append(encode_counts(missing_texts(texts, misses), tokenizer), version)
    known = keys.join(cache.counts(version), "digest")
    return known.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
