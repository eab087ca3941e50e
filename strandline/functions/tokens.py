"""Exact token counts and truncation with a vocabulary file, which is a parameter."""

from __future__ import annotations

import base64
from pathlib import Path

import pandas as pd
import tiktoken
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

_made: dict[str, tiktoken.Encoding] = {}


class Tokenizer:
    """Counts and truncates by a vocabulary of ``base64 rank`` lines and a pattern; both are broadcast, a few MB."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, Path(path).read_text().splitlines())}
        self._shared = spark.sparkContext.broadcast((f"{path} {pattern}", ranks, pattern))

    @staticmethod
    def _encoding(shared) -> tiktoken.Encoding:
        name, ranks, pattern = shared.value
        if name not in _made:
            _made[name] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return _made[name]

    def count(self, text: Column) -> Column:
        """Tokens of a text; null has none."""
        shared, encoding = self._shared, self._encoding

        def work(texts: pd.Series) -> pd.Series:
            encode = encoding(shared).encode_ordinary
            return texts.map(lambda t: len(encode(t)) if isinstance(t, str) else 0).astype("int64")

        return F.pandas_udf(work, LongType())(text)

    def truncate(self, text: Column, most: int) -> Column:
        """The text of the first ``most`` tokens; a character that is cut in two becomes a replacement mark. Null stays."""
        shared, encoding = self._shared, self._encoding

        def work(texts: pd.Series) -> pd.Series:
            own = encoding(shared)

            def cut(t):
                ids = own.encode_ordinary(t)
                return t if len(ids) <= most else own.decode(ids[:most])

            return texts.map(lambda t: cut(t) if isinstance(t, str) else None)

        return F.pandas_udf(work, StringType())(text)
