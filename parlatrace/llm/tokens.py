"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

#: Where the vocabulary files are; a parameter of everything that counts tokens.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how that byte-level vocabulary's texts are cut before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def encoding(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str = VOCABULARY) -> Column:
    """Number of tokens of the whole text; strings that look like special tokens are ordinary text. Null gives null, empty 0."""

    @F.pandas_udf(LongType())
    def count(texts: pd.Series) -> pd.Series:
        encode = encoding(path).encode_ordinary
        return texts.map(lambda t: None if t is None else len(encode(t))).astype("Int64")

    return count(text)


def text_class(text: Column) -> Column:
    """A number that texts share which differ only in case, accents, punctuation and white space: their class of copies. Texts without a letter or figure are in none (null). Collisions of the hash (64 bits) join classes."""

    @F.pandas_udf(StringType())
    def folded(texts: pd.Series) -> pd.Series:
        bare = texts.str.normalize("NFKD").str.replace(r"[\W_̀-ͯ]+", "", regex=True).str.lower()
        return bare.where(bare != "", None)

    bare = folded(text)
    return F.when(bare.isNotNull(), F.xxhash64(bare))
