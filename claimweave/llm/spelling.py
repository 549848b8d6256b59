"""Spelling variants: words that differ by one inserted, deleted or replaced code point, grouped under their frequent forms.

One edit leaves a half of a word intact, so two near words meet in a forward dictionary, as neighbours with one prefix, or in
the dictionary of reversed words, with one suffix.  Blocks of words with one such prefix or suffix are met in sorted order and
verified.  A block of too many words is subdivided: what one edit may still touch is halved again, so that its words meet under
a longer prefix or a longer suffix.  At the end of that only one code point is free, so every block is of bounded size, whatever the words.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import settle

RUN = "[A-Za-zÀ-ÿ]+"
#: Blocks of more words than this are subdivided.
BLOCK = 64


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id as text, run) of every maximal run of letters in ``docs`` (doc_id, text), A-Z lower-cased; a null doc_id reads ``null``."""
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    return docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("doc_id"), F.explode(F.regexp_extract_all(lower, F.lit(f"({RUN})"))).alias("run"))


def misspelt(found: DataFrame, every: int = 97) -> DataFrame:
    """(word) of runs (doc_id, run): where ``every`` divides the crc32 of both, one code point of the run is gone."""
    h = F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary"))
    cut = F.expr("concat(substr(run, 1, cast(h % length(run) as int)), substr(run, cast(h % length(run) as int) + 2))")
    return found.withColumn("h", h).select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, length: int = 5, least: int = 3) -> DataFrame:
    """(word, n) of words of enough code points and occurrences, as a written table."""
    return settle(words.where(F.char_length("word") >= length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least))


def _entry(kind: str, role: int, short: Column, intact: Column) -> list[Column]:
    """Two dictionary entries of a word: under half of what stays ``intact`` as a prefix, and as a suffix.

    ``short`` is the length of the shorter word of a pair; role 0 pairs words of one length, 1 is the shorter and 2 the longer one.
    """
    half = F.ceil(intact / 2).cast("int")
    zero = F.lit(0)
    return [F.struct(F.lit(kind).alias("kind"), F.lit(role).alias("role"), short.alias("short"), a.alias("a"), b.alias("b"), (intact - half).cast("int").alias("left")) for a, b in ((half, zero), (zero, half))]


def _keyed(entries: DataFrame) -> DataFrame:
    """``entries`` with the key of their block: the prefix of the word, and of the reversed word, that stay intact."""
    return entries.withColumn("key", F.xxhash64("kind", "short", "a", "b", F.expr("substr(word, 1, a)"), F.expr("substr(reverse(word), 1, b)")))


def _dictionaries(words: DataFrame) -> DataFrame:
    n = F.char_length("word")
    entries = [*_entry("replaced", 0, n, n - 1), *_entry("inserted", 1, n, n), *_entry("inserted", 2, n - 1, n - 1)]
    return _keyed(words.select("word", F.explode(F.array(*entries)).alias("e")).select("word", "e.*"))


def _halved(entries: DataFrame) -> DataFrame:
    half = F.ceil(F.col("left") / 2).cast("int")
    deeper = [F.struct((F.col("a") + x).alias("a"), (F.col("b") + y).alias("b"), (F.col("left") - half).cast("int").alias("left")) for x, y in ((half, F.lit(0)), (F.lit(0), half))]
    return _keyed(entries.select("word", "kind", "role", "short", F.explode(F.array(*deeper)).alias("d")).select("word", "kind", "role", "short", "d.*"))


def near_pairs(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, other), both ways, of all distinct ``words`` (word) that differ by exactly one code point.

    Of a pair, what lies before and after the edit is intact; half of it, rounded up, is therefore a common prefix or a common suffix.
    Blocks of up to ``block`` words, and those with nothing left to halve, are verified.
    """
    now, small = settle(_dictionaries(words.select("word"))), []
    while True:
        large = settle(now.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.max("left").alias("most")).where((F.col("c") > block) & (F.col("most") > 0)).select("key"))
        if large.isEmpty():
            small.append(now)
            break
        big = now.join(large, "key", "left_semi").where("left > 0")
        small += [now.join(large, "key", "left_anti"), now.join(large, "key", "left_semi").where("left = 0")]
        now = settle(_halved(big))
    found = None
    for part in small:
        one = part.where("role < 2").select("key", F.col("role").alias("l"), F.col("word").alias("x"))
        two = part.where("role <> 1").select("key", F.col("role").alias("r"), F.col("word").alias("y"))
        roles = ((F.col("l") == 0) & (F.col("r") == 0) & (F.col("x") < F.col("y"))) | ((F.col("l") == 1) & (F.col("r") == 2))
        met = one.join(two, "key").where(roles & (F.levenshtein("x", "y", 1) == 1)).select("x", "y")
        found = met if found is None else found.unionByName(met)
    pairs = found.distinct()
    return settle(pairs.select(F.explode(F.array(F.struct(F.col("x").alias("word"), F.col("y").alias("other")), F.struct(F.col("y").alias("word"), F.col("x").alias("other")))).alias("p")).select("p.*"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, form) that lead upwards: pointer doubling until no root moves."""
    now = settle(links.select("word", F.col("form").alias("root")))
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        then = settle(now.join(up, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if then.where("moved").isEmpty():
            return now
        now = then.select("word", "root")


def group(words: DataFrame, times: int = 2, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near and form_n of a ``vocabulary`` (word, n; words are distinct).

    A word's form is its near word of the largest n (ties: the smallest in code-point order), if that is ``times`` the word's n or more.  Forms
    grow along a chain, so chains end.
    """
    pairs = near_pairs(words, block).join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other"))).alias("best"))
    fits = -F.col("best.m") >= times * F.col("n")
    told = settle(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.m")).alias("form_n")))
    ends = roots(told.where("form is not null").select("word", "form"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, every: int = 97, length: int = 5, least: int = 3, times: int = 2, block: int = BLOCK) -> DataFrame:
    """``group`` of the words of all whole texts of ``docs`` (doc_id, text).

    Null and empty texts have no words, and an empty table gives no rows; repeated rows count each time; a null doc_id reads ``null`` where
    runs are misspelt; runs of any length are words; extra columns are not looked at.
    """
    return group(vocabulary(misspelt(runs(docs), every), length, least), times, block)
