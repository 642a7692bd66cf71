"""Column functions for text: tokenization and stop words.

Everything is a built-in Catalyst expression (``regexp_extract_all``,
``filter``, ``array_contains``) so it runs inside whole-stage codegen; no
Python UDF is involved.
"""

from __future__ import annotations

import functools
import glob
import os
import zipfile

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Token pattern (Java regex, matched not split): a token starts with a letter,
# digit, '#' or '@', may contain dashes, connectors, symbols and punctuation
# and ends with a letter or digit; single letters/digits and single
# non-punctuation, non-blank characters are tokens too.
TOKEN_PATTERN = (r"([\p{L}\p{N}#@][\p{L}\p{N}\p{Pd}\p{Pc}\p{S}\p{P}]*[\p{L}\p{N}])"
                 r"|[\p{L}\p{N}]|[^\p{P}\s]")


def tokenize(text: Column | str, pattern: str = TOKEN_PATTERN, to_lowercase: bool = True) -> Column:
    """Tokens of ``text`` (gaps=False semantics of ``RegexTokenizer``).

    Null text gives null; text without tokens gives an empty array.
    """
    col = F.col(text) if isinstance(text, str) else text
    if to_lowercase:
        col = F.lower(col)
    return F.regexp_extract_all(col, F.lit(pattern), 0)


@functools.lru_cache(maxsize=None)
def default_stop_words(language: str = "english") -> tuple[str, ...]:
    """Spark ML's default stop-word list for ``language`` (read from the
    spark-mllib jar, the same list ``StopWordsRemover.loadDefaultStopWords`` gives)."""
    import pyspark
    jars = glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "spark-mllib_*.jar"))
    if not jars:  # pragma: no cover - fall back to the JVM
        from pyspark.ml.feature import StopWordsRemover
        return tuple(StopWordsRemover.loadDefaultStopWords(language))
    with zipfile.ZipFile(jars[0]) as z:
        raw = z.read(f"org/apache/spark/ml/feature/stopwords/{language}.txt").decode("utf-8")
    return tuple(w for w in raw.split("\n") if w)


def remove_stop_words(tokens: Column | str, stop_words=None, language: str | None = "english",
                      case_sensitive: bool = False) -> Column:
    """Drop stop words from a token array (order kept)."""
    col = F.col(tokens) if isinstance(tokens, str) else tokens
    words = list(stop_words) if stop_words is not None else list(default_stop_words(language or "english"))
    if not case_sensitive:
        words = sorted({w.lower() for w in words})
        stop = F.array(*[F.lit(w) for w in words])
        return F.filter(col, lambda t: ~F.array_contains(stop, F.lower(t)))
    stop = F.array(*[F.lit(w) for w in words])
    return F.filter(col, lambda t: ~F.array_contains(stop, t))


def sql_string_list(values) -> str:
    """DuckDB list literal of strings (for oracles)."""
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def remove_stop_words_df(df, in_col: str, out_col: str | None = None, stop_words=None,
                         language: str | None = "english", case_sensitive: bool = False):
    """X2 on a DataFrame with Spark ML's ``StopWordsRemover`` (a JVM hash-set
    lookup per token: several times faster than ``array_contains`` over a
    literal list).  Replaces ``in_col`` when ``out_col`` is None."""
    from pyspark.ml.feature import StopWordsRemover
    words = list(stop_words) if stop_words is not None else list(default_stop_words(language or "english"))
    tmp = out_col or f"_{in_col}_nostop"
    out = StopWordsRemover(inputCol=in_col, outputCol=tmp, stopWords=words, caseSensitive=case_sensitive).transform(df)
    if out_col is None:
        out = out.drop(in_col).withColumnRenamed(tmp, in_col)
    return out
