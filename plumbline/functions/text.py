"""Text functions. Tokens are native; NFKC and sequence similarity have no built-in form and are Arrow functions."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import ArrowUDFType
from pyspark.sql.pandas.types import to_arrow_type

#: Rows of a batch that are Python's objects at a time; characters of two texts whose ratio is kept for when they meet again.
ROWS, SHORT = 256, 128

#: What normalising deletes, the CJK block that is read by character, a latin word.
DELETED = r"[\s　，。、；：？！“”‘’（）【】《》〈〉,.;:?!\"'()\[\]{}<>—\-_*`#>|]+"
CJK = "一-鿿"
WORD = "[a-z0-9]+"
_DELETED, _WORD, _CJK = re.compile(DELETED), re.compile(WORD), re.compile(f"[{CJK}]")


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition; nulls stay."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two texts, in this order: it isn't symmetric. Two empty texts are equal."""
    return pd.Series([ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.StringType())
def first_json_object(text: pd.Series) -> pd.Series:
    """The first JSON object of a model's answer as compact JSON with sorted keys, or null."""
    found = text.map(lambda t: None if t is None else parse_object(t))
    return found.map(lambda o: None if o is None else json.dumps(o, ensure_ascii=False, sort_keys=True, separators=(",", ":")))


def folded(text: str) -> str:
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).lower()


def normalised(text: str) -> str:
    low = folded(text)
    return low if low.isalnum() else _DELETED.sub("", low)  # letters and digits are never deleted


def token_list(text: str) -> list[str]:
    low = folded(text)
    return _WORD.findall(low) if low.isascii() else _WORD.findall(low) + _CJK.findall(low)


def ratio(a: str, b: str) -> float:
    """The share of matching blocks: 1 for equal texts, 0 for those without a common character."""
    if a == b:
        return 1.0
    if set(a).isdisjoint(b):
        return 0.0
    return _short_ratio(a, b) if len(a) + len(b) <= SHORT else SequenceMatcher(None, a, b).ratio()


@lru_cache(1 << 15)
def _short_ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def by_rows(made: Callable, kind: str, *columns: Column) -> Column:
    """What made makes of each row's values, some rows at a time: no more than those are Python's objects.

    Told as not deterministic, since Spark computes others twice beneath explode: once for the filter that it infers.
    """
    arrow = to_arrow_type(T._parse_datatype_string(kind))

    def run(*batch: pa.Array) -> pa.Array:
        parts = [pa.array([made(*row) for row in zip(*(c.slice(at, ROWS).to_pylist() for c in batch), strict=True)], arrow) for at in range(0, len(batch[0]), ROWS)]
        return pa.concat_arrays(parts) if parts else pa.array([], arrow)

    run.__annotations__ = {}
    return F.arrow_udf(run, kind, ArrowUDFType.SCALAR).asNondeterministic()(*columns)


def parse_object(text: str) -> dict | None:
    """An object in what a model wrote: without its code fence, from the first brace on, whatever follows it."""
    body = text.strip()
    if body.startswith("```") and body.endswith("```") and len(body) >= 6:
        body = re.sub(r"^(json)?\s*", "", body[3:-3])
    start = body.find("{")
    if start < 0:
        return None
    try:
        found, _ = json.JSONDecoder().raw_decode(body, start)
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def normalise(text: Column, compose: bool = True) -> Column:
    """Lower case without spaces and punctuation. Without compose it stays in the JVM, for texts known to be NFKC."""
    return F.regexp_replace(F.lower(nfkc(text) if compose else text), DELETED, "")


def tokens(text: Column, compose: bool = False) -> Column:
    """Latin words and digits, then CJK characters one by one; letters of other scripts are no tokens."""
    low = F.lower(nfkc(text) if compose else text)
    return F.concat(F.regexp_extract_all(low, F.lit(f"({WORD})"), 1), F.regexp_extract_all(low, F.lit(f"([{CJK}])"), 1))


def token_bag(text: Column) -> Column:
    """tokens() in the order of the text, in one pass: for uses that only count them."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD}|[{CJK}])"), 1)


def search_tokens(text: Column) -> Column:
    """tokens() and the pairs of neighbouring CJK characters; a pair never spans anything else."""
    low = F.lower(text)
    runs = F.regexp_extract_all(low, F.lit(f"([{CJK}]{{2,}})"), 1)
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, 2))))
    return F.concat(tokens(text), pairs)


def ngrams(text: Column, n: int) -> Column:
    """The distinct runs of n characters; none in a shorter text."""
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, n)))).otherwise(F.array().cast("array<string>"))
