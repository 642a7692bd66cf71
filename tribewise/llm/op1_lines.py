"""Line dedup by winnowing, in DataFrame functions only.

A document is its sequence of non-blank lines.  A line weighs its words (blanks
between its ends plus one, or a tenth of its characters if that is more), and a
third of ``min_words`` at least, so that three lines always count.  Windows are
the shortest stretches of lines from a line on, or up to a line, that weigh
``min_words`` or more: one long line, two middling ones, or ``window`` short ones.
They depend on content alone, so a run of lines that recurs holds the same windows
wherever it stands, and these cover it to its last line.

The line with the smallest hash in a window is a fingerprint, so any shared window
shares one at the same place.  Positions of fingerprints that occur more than once
are joined; each extends both ways over the windows that selected it, and a window
that also stands earlier (by key, then place) is a repeat.  Neighbouring repeats
make up the maximal repeated run; its lines are deleted, and the first standing
of the run stays.

So a repeated run goes if it has ``window`` lines or ``min_words`` words, wherever it
stands in a document; a shorter one stays, also as a first or last line.

Cases: null text has no lines and stays null; blank lines are not compared and
stay; rows with equal key and equal text are one document and get one result;
a null key ranks first; an empty table gives no rows; extra columns pass
through, and columns named like an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, text_key, written

WINDOW, MIN_WORDS, WORD_CHARS = 3, 50, 10
ADDED = ("n_lines", "n_removed", "deduped")


def _let(value, body):
    """``body`` of ``value``, which is computed once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def _elements(text: str, window: int, min_words: int):
    """(h, g, line, words) of each non-blank line, with ``words`` its weight."""
    def words(x):
        blanks = F.length(x) - F.length(F.translate(x, " ", ""))
        return F.greatest(blanks + 1, F.floor(F.length(x) / WORD_CHARS).cast("int"), F.lit(-(-min_words // window)))

    line = F.transform(F.split(F.col(text), "\n"), lambda x, i: _let(F.trim(x), lambda t: F.struct(
        F.xxhash64(x).alias("h"), F.xxhash64(F.lit(7), x).alias("g"), F.when(t != "", i).otherwise(-1).alias("line"),
        words(t).alias("words"))))
    return F.filter(line, lambda e: e["line"] >= 0)


def _positions(elements, window: int, min_words: int):
    """Fingerprints: hash and the windows (start, content, lines) that select that position."""
    def one(w, s, j):  # the j + 1 lines from s on, null unless they are a window
        total = F.aggregate(w, F.lit(0), lambda a, e: a + e["words"])
        return _let(total, lambda t: F.when((t >= min_words) & ((t - w[j]["words"] < min_words) | (t - w[0]["words"] < min_words)), _let(
            F.array_min(F.transform(w, lambda e: e["h"])), lambda least: F.struct(
                (s + F.array_position(F.transform(w, lambda e: e["h"]), least).cast("int") - 1).alias("at"),
                s.alias("start"), F.xxhash64(F.transform(w, lambda e: e["g"])).alias("content"),
                F.transform(w, lambda e: e["line"]).alias("lines")))))

    def windows(seq):  # for each line those that start there
        return F.transform(seq, lambda e, s: F.filter(
            F.transform(F.slice(seq, s + 1, window), lambda f, j: _let(F.slice(seq, s + 1, j + 1), lambda w: one(w, s, j))),
            lambda w: w.isNotNull()))

    def grouped(seq, of):
        places = F.array_distinct(F.flatten(F.transform(of, lambda ws: F.transform(ws, lambda w: w["at"]))))
        return F.transform(places, lambda p: F.struct(seq[p]["h"].alias("fp"), F.filter(
            F.flatten(F.slice(of, F.greatest(p - window + 1, F.lit(0)) + 1, F.least(p + 1, F.lit(window)))),
            lambda w: w["at"] == p).alias("windows")))

    return _let(elements, lambda seq: _let(windows(seq), lambda of: grouped(seq, of)))


def repeated_lines(docs: DataFrame, key: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   min_words: int = MIN_WORDS) -> DataFrame:
    """(key, h1, h2, removed): line numbers to delete, for documents that have any; h1 and h2 name the text.

    The table is written; those that led to it are deleted before any text moves.
    """
    source = docs.select(F.col(key).alias("k"), *text_key(text_col), F.col(text_col).alias("text")).filter("text is not null")
    found = source.select("k", "h1", "h2", F.explode(_positions(_elements("text", window, min_words), window, min_words)).alias("p"))
    found = written(found.select("k", "h1", "h2", "p.fp", "p.windows"), "fingerprints")
    # counts and firsts are written before they are joined, so that hot lines can be split; these tables grow
    # with the input, so they are merged at every size and never broadcast
    shared = written(found.groupBy("fp").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("fp"), "shared")
    extended = found.join(shared.hint("merge"), "fp").select("fp", "k", "h1", "h2", F.explode("windows").alias("w")).select(
        "fp", F.col("w.content").alias("content"), F.struct("k", "h1", "h2", F.col("w.start").alias("start")).alias("here"),
        F.col("w.lines").alias("lines"))
    first = written(extended.groupBy("fp", "content").agg(F.min("here").alias("first"), F.max("here").alias("last"))
                    .filter("first < last").select("fp", "content", "first"), "firsts")
    later = extended.join(first.hint("merge"), ["fp", "content"]).filter("here > first")
    gone = written(later.select("here.k", "here.h1", "here.h2", F.explode("lines").alias("line"))
                   .groupBy("k", "h1", "h2").agg(F.array_sort(F.collect_set("line")).alias("removed")), "gone")
    for used in (found, shared, first):
        free(used)
    return gone


def deduplicated(docs: DataFrame, key: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                 min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with n_lines, n_removed and ``deduped``, the text without its repeated lines."""
    base = docs.drop(*ADDED)
    h1, h2 = text_key(text_col)
    left = base.withColumns({"_ld_a": h1, "_ld_b": h2})
    gone = repeated_lines(docs, key, text_col, window, min_words).select(
        F.col("k").alias("_ld_k"), F.col("h1").alias("_ld_h1"), F.col("h2").alias("_ld_h2"), F.col("removed").alias("_ld_gone"))
    docs.sparkSession.sparkContext._jvm.System.gc()  # the shuffle files of the steps before go, too
    joined = left.join(gone.hint("merge"), F.col(key).eqNullSafe(F.col("_ld_k")) & (F.col("_ld_a") == F.col("_ld_h1"))
                       & (F.col("_ld_b") == F.col("_ld_h2")), "left")
    removed, split = F.col("_ld_gone"), F.split(F.col(text_col), "\n")

    def kept(lines):  # the stretches between removed lines
        edges = F.concat(F.array(F.lit(-1)), removed, F.array(F.size(lines)))
        return _let(edges, lambda e: F.flatten(F.transform(
            F.sequence(F.lit(0), F.size(e) - 2), lambda i: F.slice(lines, e[i] + 2, e[i + 1] - e[i] - 1))))

    return joined.select(
        *base.columns, F.when(F.col(text_col).isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"),
        F.when(removed.isNull(), 0).otherwise(F.size(removed)).cast("long").alias("n_removed"),
        F.when(removed.isNull(), F.col(text_col)).otherwise(F.array_join(_let(split, kept), "\n")).alias("deduped"))
