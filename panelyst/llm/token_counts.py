"""Token counts through a digest cache.

Counts are stored under (content digest, tokenizer digest). A run looks every
text up, encodes only the distinct texts that the cache lacks, appends their
counts to it and reads the result from it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from . import common as C

CACHE_SCHEMA = "digest string, tokenizer string, n_tokens long"
_LOADED: dict = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return name if "/" in name else public_tokenizers.path(name)


def version(name: str) -> str:
    """Digest of the tokenizer's file: another version never meets old counts."""
    with open(tokenizer_path(name), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def counter(name: str):
    """A function from a list of texts to their token counts, loaded once per process."""
    if name not in _LOADED:
        if name.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))
            _LOADED[name] = lambda texts: [len(sp.encode(t, num_threads=1)) for t in texts]
        else:
            from tokenizers import Tokenizer

            tk = Tokenizer.from_file(tokenizer_path(name))
            tk.no_truncation()
            tk.no_padding()
            _LOADED[name] = lambda texts: [len(tk.encode(t, add_special_tokens=False)) for t in texts]
    return _LOADED[name]


def count_tokens(docs: DataFrame, cache_path: str, tokenizer: str) -> DataFrame:
    """One row per input row: its columns without the text, ``n_bytes``, ``n_tokens``.

    Null texts count as empty. Repeated texts are encoded once. The cache is an
    append-only parquet table; rows of the same key are equal, so appending one
    twice (a retried job) changes no result.
    """
    spark, ver = docs.sparkSession, version(tokenizer)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.drop("digest", "n_bytes", "n_tokens").withColumns(
        {"text": text, "digest": F.sha2(text, 256), "n_bytes": F.octet_length(text).cast("long")}
    )
    try:
        cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except Exception as e:  # only a missing table means an empty cache
        if "PATH_NOT_FOUND" not in str(e):
            raise
        cache = None
    misses = keyed.select("digest", "text").distinct()
    if cache is not None:
        misses = misses.join(cache.where(F.col("tokenizer") == ver).select("digest"), "digest", "left_anti")

    def encode(batches):
        count = counter(tokenizer)
        for pdf in C.slices(batches):
            yield pd.DataFrame({"digest": pdf["digest"], "tokenizer": ver, "n_tokens": np.array(count(list(pdf["text"])), np.int64)})

    misses.mapInPandas(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    known = (
        spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
        .where(F.col("tokenizer") == ver).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    )
    return keyed.drop("text").join(known, "digest").drop("digest")


def op6_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str = "piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents").select("doc_id", "text")
    cache = C.Tables(spark, "token-counts").path("cache")
    return count_tokens(docs, cache, tokenizer).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
