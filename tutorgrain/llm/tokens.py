"""Token counts of a public byte-level BPE tokenizer inside Arrow batches."""

from __future__ import annotations

import base64
import sys

import pandas as pd
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the vocabulary file lies; operators take another path as parameter.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the splitting pattern that belongs to this vocabulary
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary(path: str = TOKENIZER) -> bytes:
    """The vocabulary file as it is (under 1 MB); the driver reads it and workers get it by broadcast."""
    with open(path, "rb") as f:
        return f.read()


def encoding(raw: bytes) -> tiktoken.Encoding:
    """The encoder of a vocabulary file, made once per Python worker."""
    kept = sys.__dict__.setdefault("_tutorgrain_encodings", {})
    key = hash(raw)
    if key not in kept:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        kept[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return kept[key]


def encode(enc: tiktoken.Encoding, text: str) -> list[int]:
    """Tokens of a whole text; lone surrogates are replaced as they cannot be encoded."""
    try:
        return enc.encode_ordinary(text)
    except UnicodeEncodeError:
        return enc.encode_ordinary(text.encode("utf-16", "surrogatepass").decode("utf-16", "replace"))


def token_count(spark: SparkSession, text: Column, path: str = TOKENIZER) -> Column:
    """Number of tokens of a text column; null and empty texts have none."""
    shared = spark.sparkContext.broadcast(vocabulary(path))

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        enc = encoding(shared.value)
        return pd.Series([len(encode(enc, t)) if t else 0 for t in texts], dtype="int32")

    return count(text)


def sized(docs: DataFrame, doc_id: str, text: str, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of every document."""
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), token_count(docs.sparkSession, F.col(text), path).alias("n_tokens"))
