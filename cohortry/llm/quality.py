"""Rules on words and lines of documents, and lines that many documents of one host share.

Column expressions only.  A text is read twice: once for what can be counted in it alone, once for
its lines.  Lines leave it as 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import WHITE, free_name, stored, text_or_empty

#: A line is removed within a host if more distinct documents than both of these have it.  The share
#: is a parameter of the functions; with 0 the number of documents decides alone.
LINE_DOCS, LINE_SHARE = 20, 0.1
#: A document is depleted if fewer words, or a smaller share of them, remain.
LEAST_WORDS, LEAST_SHARE = 10, 0.3
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def _twins(ordered: str) -> Column:
    """Of sorted (v, i) pairs, every i whose v stands next to an equal one.  ``ordered`` must be a column: it is looked up by place."""
    at = lambda k: F.get(F.col(ordered), k)["v"]
    none = F.lit(False)
    same = F.filter(F.col(ordered), lambda p, k: F.coalesce(p["v"] == at(k - 1), none) | F.coalesce(p["v"] == at(k + 1), none))
    return F.transform(same, lambda p: p["i"])


def _covered(places: str) -> Column:
    """How many words windows at the given sorted places cover together."""
    own = F.lit(WINDOW)
    return F.aggregate(
        F.transform(F.col(places), lambda p, k: F.least(own, F.coalesce(F.get(F.col(places), k + 1) - p, own))), F.lit(0).cast("long"), lambda acc, s: acc + s
    )


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Words are runs of other than white space (space, tab to carriage return); a NULL text has none.
    ``n_repeat_words`` counts the words in windows of five words that stand twice or more in the
    text, the first one included.  ``base_failed``: fewer than 10 words, or more than a fifth of them
    in such windows.
    """
    names = {n: free_name(docs, f"_{n}") for n in ("t", "words", "lines", "hashes", "windows", "by_hash", "near", "by_words", "places")}
    t, words, lines, hashes, windows, by_hash, near, by_words, places = names.values()
    # Each step is a column of its own, so that none is worked out again inside a lambda.
    out = docs.withColumn(t, text_or_empty(text))
    out = out.withColumn(words, F.array_remove(F.split(F.col(t), "[\\x20\\x09-\\x0D]+"), ""))
    blank = WHITE.replace("\n", "")
    out = out.withColumns({
        lines: F.filter(F.split(F.col(t), "\n"), lambda x: F.translate(x, blank, "") != ""),
        hashes: F.transform(F.col(words), lambda w: F.xxhash64(w)),
    })
    at = F.sequence(F.lit(0), F.size(words) - WINDOW)
    hashed = F.transform(at, lambda i: F.xxhash64(*[F.get(F.col(hashes), i + k) for k in range(WINDOW)]))
    out = out.withColumn(windows, F.when(F.size(words) >= WINDOW, hashed))
    # equal hashes first, which most texts lack; then the words themselves
    some = F.size(F.array_distinct(windows)) < F.size(windows)
    out = out.withColumn(by_hash, F.when(some, F.sort_array(F.transform(F.col(windows), lambda h, i: F.struct(h.alias("v"), i.alias("i"))))))
    out = out.withColumn(near, F.when(F.col(by_hash).isNotNull(), _twins(by_hash)))
    spelt = F.transform(F.col(near), lambda i: F.struct(F.concat_ws(" ", F.slice(F.col(words), i + 1, F.lit(WINDOW))).alias("v"), i.alias("i")))
    out = out.withColumn(by_words, F.sort_array(spelt))
    out = out.withColumn(places, F.sort_array(_twins(by_words)))
    out = out.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.char_length(F.translate(F.col(t), WHITE, "")).cast("long"),
        "n_symbols": (F.char_length(t) - F.char_length(F.translate(F.col(t), SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": F.coalesce(_covered(places), F.lit(0).cast("long")),
    })
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop(*names.values())


def _normal_lines(text: Column) -> Column:
    """Distinct lines with a word: lower case, single spaces, every digit a 0."""
    flat = F.regexp_replace(F.translate(F.lower(text), "123456789", "000000000"), "[ \\x09\\x0B-\\x0D]+", " ")
    return F.array_distinct(F.filter(F.transform(F.split(flat, "\n"), lambda x: F.trim(x)), lambda x: x != ""))


def _keys(source: str, text: str) -> list[Column]:
    return [F.coalesce(F.col(source).cast("string"), F.lit("\x00")).alias("_host"), F.unhex(F.md5(text_or_empty(text))).alias("_doc")]


def lost_words(docs: DataFrame, source: str = "source", text: str = "text", share: float = LINE_SHARE) -> DataFrame:
    """(_host, _doc, all_words, lost): words on distinct lines of a text, and those on lines above the limits.

    Exact copies are one document: ``_doc`` is a digest of the text.  Of the documents that share a
    removed line, the one with the least digest keeps it, so that a group of near copies does not
    vanish as a whole.  Only documents that lose words are listed.

    Counts combine before their shuffles: (host, line, document) first, then (host, line); a line
    that very many documents have is met again only in a join, whose skew can be split.
    """
    lines = docs.select(*_keys(source, text), F.explode(_normal_lines(text_or_empty(text))).alias("line"))
    lines = lines.select("_host", "_doc", F.xxhash64("line").alias("line"), (F.char_length("line") - F.char_length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1).cast("long").alias("w"))
    lines = stored(lines.groupBy("_host", "line", "_doc").agg(F.max("w").alias("w")), "lines")
    often = lines.groupBy("_host", "line").agg(F.count("*").alias("docs"), F.min("_doc").alias("keeper")).where(F.col("docs") > LINE_DOCS)
    if share > 0:
        hosts = lines.select("_host", "_doc").distinct().groupBy("_host").agg(F.count("*").alias("all_docs"))
        often = often.join(hosts, "_host").where(F.col("docs") > share * F.col("all_docs"))
    removed = often.select("_host", "line", "keeper")
    return lines.join(removed, ["_host", "line"]).where("_doc != keeper").groupBy("_host", "_doc").agg(F.sum("w").alias("lost"))


def judged(docs: DataFrame, source: str = "source", text: str = "text", share: float = LINE_SHARE) -> DataFrame:
    """``docs`` with the base counts, line_words, lost_words and kept.

    A document is kept if the base rules pass and it is not depleted by the removal of lines that
    more than ``LINE_DOCS`` documents and more than the share ``share`` of its host have.
    Documents without a source are one host.  Repeated rows get the same verdict; an empty table
    gives an empty result.  Columns of ``docs`` that have the name of a result are replaced.
    """
    lost = lost_words(docs, source, text, share).withColumnRenamed("lost", "lost_words")
    host, doc = _keys(source, text)
    words = F.aggregate(_normal_lines(text_or_empty(text)), F.lit(0).cast("long"), lambda a, x: a + F.size(F.split(x, " ")))
    rows = base_counts(docs.drop("lost_words"), text).withColumns({"_host": host, "_doc": doc, "line_words": words})
    none = F.lit(0).cast("long")
    out = rows.join(lost, ["_host", "_doc"], "left").withColumn("lost_words", F.coalesce("lost_words", none))
    left = F.col("line_words") - F.col("lost_words")
    depleted = (F.col("lost_words") > 0) & ((left < LEAST_WORDS) | (left < LEAST_SHARE * F.col("line_words")))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted).drop("_host", "_doc")


def kept(docs: DataFrame, source: str = "source", text: str = "text", share: float = LINE_SHARE) -> DataFrame:
    """The documents that ``judged`` keeps, with the columns they came with.

    Runs a job: rows and verdicts are stored first.  A filter on the verdict would otherwise be pushed
    through every step of the counts, each of which would be spelt out again inside it.
    """
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text"), F.col(source).alias("_source"))
    return stored(judged(rows, "_source", "_text", share).select("_row", "kept"), "verdicts").where("kept").select("_row.*")
