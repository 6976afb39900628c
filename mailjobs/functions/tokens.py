"""Token counting, with a public vocabulary unless the caller supplies an encoder."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def public_encoder(name: str = "byte_bpe_50k.tiktoken") -> Callable[[str], list]:
    """The encoder of a rank file among the public vocabularies of the machine."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as file:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def count_tokens(c: Column, load: Callable[[], Callable[[str], list]] = public_encoder) -> Column:
    """Number of tokens of each text, null for null. ``load`` returns the encoder; it runs once for
    each Python worker's stream of batches, not for each row."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for batch in batches:
            yield batch.map(lambda t: None if t is None else len(encode(t))).astype("Int64")

    return run(c)
