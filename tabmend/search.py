"""Full-text search over tables, as the full-text tables answer it, without leaving Spark.

Text is folded (lower case, without marks) and split at everything but letters and
digits. An index is a table of postings; a query for all of some words intersects
theirs by one grouped count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters with marks and their bases, for Latin-1 and Latin Extended-A.
_MARKED = {"a": "àáâãäåāăą", "c": "çćĉċč", "d": "ď", "e": "èéêëēĕėęě", "g": "ĝğġģ", "h": "ĥ", "i": "ìíîïĩīĭį", "j": "ĵ", "k": "ķ", "l": "ĺļľ", "n": "ñńņň", "o": "òóôõöōŏő", "r": "ŕŗř", "s": "śŝşš", "t": "ţť", "u": "ùúûüũūŭůűų", "w": "ŵ", "y": "ýÿŷ", "z": "źżž"}


def folded(text: Column) -> Column:
    letters = "".join(_MARKED.values())
    bases = "".join(b * len(m) for b, m in _MARKED.items())
    return F.regexp_replace(F.translate(F.lower(text), letters, bases), r"\p{M}+", "")


def terms(text: Column) -> Column:
    """Distinct words of a text."""
    return F.array_distinct(F.filter(F.split(folded(text), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def search_all(df: DataFrame, columns: list[str], words: list[str]) -> DataFrame:
    """Rows whose columns together hold every word; one scan, no shuffle."""
    text = F.concat_ws(" ", *columns)
    wanted = terms(F.lit(" ".join(words)))
    return df.filter(F.size(F.array_except(wanted, terms(text))) == 0)


def postings(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(term, key) of every distinct word of every row: the index to write once, sorted by term for pruning."""
    return df.select(F.explode(terms(F.concat_ws(" ", *columns))).alias("term"), F.col(key))


def lookup_all(index: DataFrame, key: str, words: list[str]) -> DataFrame:
    """Keys whose postings hold every word."""
    wanted = [r[0] for r in index.sparkSession.range(1).select(F.explode(terms(F.lit(" ".join(words))))).collect()]
    hits = index.filter(F.col("term").isin(wanted)).groupBy(key).agg(F.count_distinct("term").alias("n"))
    return hits.filter(F.col("n") == len(wanted)).select(key)
