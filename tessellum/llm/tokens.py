"""Token counts of public tokenizers, whose vocabulary files are named by a path parameter."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Default of the path parameter: a byte-level BPE vocabulary file for the tokenizers library.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizer of a vocabulary file, once per worker process. Special tokens in a text are ordinary text."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return tok


def count_tokens(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of the whole text; null and empty texts have 0."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        tok = load(vocabulary)
        out: list[int] = []
        part: list[str] = []
        size = 0
        for t in [*texts, None]:  # batches of some 100,000 characters keep a worker's memory flat
            part.append(t or "")
            size += len(t or "")
            if size > 100_000 or len(part) == 64:
                out += [len(e.ids) for e in tok.encode_batch(part, add_special_tokens=False)]
                part, size = [], 0
        out += [len(e.ids) for e in tok.encode_batch(part, add_special_tokens=False)]
        return pd.Series(out[: len(texts)])

    return count(text)
