"""Quality rules by distribution divergence, in DataFrame functions alone.

A document is compared with its language by two histograms: character classes
and common words. The Jensen-Shannon distance (base 2, so 0 to 1) to the
reference of the language must stay below a limit, and texts too short for a
stable histogram are let through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import key_text, stored

SPACES = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]"
POINTS = "[.,;:!?'\"()-]+"
SYMBOLS = "[#*$%&|<>]"
#: Common words in a reference, least share of the documents that makes a language's own reference (so there are at most 100).
COMMON_WORDS = 16
LEAST_SHARE = 0.01
#: Guards and limits.
LEAST_CHARS = 200
LEAST_WORDS = 80
CLASS_LIMIT = 0.26
WORD_LIMIT = 0.42
POOLED, NULL = "p", "n"


def _without(text: Column, pattern: str) -> Column:
    return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))


def measured(docs: DataFrame) -> DataFrame:
    """Add to doc_id and lang: words and the counts of the base rules and of character classes.

    Windows of three words are sorted within one text by a 64-bit hash, less
    the low bits that hold their place, and equal neighbours of that order are
    compared word by word.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = docs.select("doc_id", key_text(F.col("lang")).alias("lang_key"), text.alias("text"), F.array_remove(F.split(text, SPACES + "+"), "").alias("words"))
    split = split.withColumn("bits", F.greatest(F.lit(1), F.ceil(F.log2(F.size("words") + F.lit(1))).cast("int"))).withColumn("mask", F.call_function("shiftleft", F.lit(-1).cast("bigint"), F.col("bits")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    # A window's hash with its low bits replaced by its place: long arrays sort several times faster than structs.
    windows = F.transform(
        F.slice("words", F.lit(1), F.greatest(F.size("words") - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)).bitwiseAND(F.col("mask")).bitwiseOR(i.cast("bigint")),
    )
    counted = split.select(
        "doc_id",
        "lang_key",
        "words",
        F.size("words").cast("bigint").alias("n_words"),
        F.char_length("text").cast("bigint").alias("n_chars"),
        F.coalesce(F.char_length(F.array_join("words", "")), F.lit(0)).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        lines.alias("lines"),
        "bits",
        F.sort_array(windows).alias("sorted"),
        (F.octet_length("text") - F.char_length("text")).cast("bigint").alias("wide"),
        _without(F.col("text"), "[0-9]+").cast("bigint").alias("digits"),
        _without(F.col("text"), "[A-Z]+").cast("bigint").alias("upper"),
        _without(F.col("text"), POINTS).cast("bigint").alias("points"),
    )
    top = lambda e: F.call_function("shiftright", e, F.col("bits"))
    place = lambda e: (e - F.call_function("shiftleft", top(e), F.col("bits"))).cast("int")
    word = lambda e, j: F.get("words", place(e) + j)
    # Of words, only those of windows with equal hashes are looked at.
    match = lambda e, x: F.coalesce((top(x) == top(e)) & (word(x, 0) == word(e, 0)) & (word(x, 1) == word(e, 1)) & (word(x, 2) == word(e, 2)), F.lit(False))
    same = lambda e, k: match(e, F.get("sorted", k + 1)) | match(e, F.get("sorted", k - 1))
    repeated = counted.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint")).withColumn("at", F.sort_array(F.transform(F.filter("sorted", same), place)))
    covered = F.aggregate(F.transform("at", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("at", k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    spaces = F.col("n_chars") - F.col("word_chars")
    rest = F.greatest(F.lit(0), F.col("n_chars") - spaces - F.col("wide") - F.col("digits") - F.col("upper") - F.col("points") - F.col("n_symbols"))
    classes = F.array(*(c.cast("double") for c in (rest, F.col("wide"), F.col("digits"), F.col("upper"), F.col("points"), F.col("n_symbols"), spaces)))
    return repeated.select("doc_id", "lang_key", "words", "n_words", "n_chars", "word_chars", "n_symbols", "n_dup_lines", covered.cast("bigint").alias("n_repeat_words"), classes.alias("classes"))


def references(docs: DataFrame) -> DataFrame:
    """One reference for each language with a share of documents, and a pooled one for all others.

    Counts cover all documents, and those of the pool all words of all
    languages. Columns: lang_key, docs, ref_words (the most common words),
    ref_word_p (their shares, then that of all other words) and ref_class_p.
    Two passes over the texts.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(key_text(F.col("lang")).alias("lang_key"), text.alias("text"))
    words = stored(keyed.select("lang_key", F.explode(F.array_remove(F.split("text", SPACES + "+"), "")).alias("word")).groupBy("lang_key", "word").agg(F.count("*").alias("n")), "word-counts")
    rank = "row_number() over (partition by lang_key order by n desc, word) as place"
    # Spark keeps COMMON_WORDS rows of each language per task before it shuffles any by language.
    per_word = stored(words.selectExpr("*", rank).where(F.col("place") <= COMMON_WORDS), "common-words")
    n = lambda c: F.sum(c.cast("double"))
    t = F.col("text")
    points = _without(t, POINTS)
    parts = {"wide": F.octet_length("text") - F.char_length("text"), "digits": _without(t, "[0-9]+"), "upper": _without(t, "[A-Z]+"), "points": points, "symbols": F.regexp_count("text", F.lit(SYMBOLS)), "spaces": _without(t, SPACES + "+")}
    counted = keyed.groupBy("lang_key").agg(F.count("*").alias("docs"), n(F.char_length("text")).alias("chars"), *(n(c).alias(k) for k, c in parts.items()))
    sizes = words.groupBy("lang_key").agg(F.sum(F.col("n").cast("double")).alias("words"))
    sums = stored(counted.join(sizes, "lang_key", "left").withColumn("words", F.coalesce("words", F.lit(0.0))), "class-sums")
    pooled_sums = sums.groupBy(F.lit(POOLED).alias("lang_key")).agg(*(F.sum(c).alias(c) for c in sums.columns[1:]))
    pooled_words = words.groupBy(F.lit(POOLED).alias("lang_key"), "word").agg(F.sum("n").alias("n")).selectExpr("*", rank).where(F.col("place") <= COMMON_WORDS)
    top = per_word.unionByName(pooled_words).groupBy("lang_key").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("minus"), "word"))).alias("top"))
    both = sums.unionByName(pooled_sums).join(top, "lang_key", "left")
    rest = F.col("chars")
    for k in parts:
        rest = rest - F.col(k)
    classes = F.array(F.greatest(F.lit(0.0), rest), "wide", "digits", "upper", "points", "symbols", "spaces")
    counts = F.transform("top", lambda x: (-x["minus"]).cast("double"))
    shares = F.concat(F.transform(counts, lambda x: x / F.col("words")), F.array(1 - F.aggregate(counts, F.lit(0.0), lambda a, x: a + x) / F.col("words")))
    return both.select("lang_key", "docs", F.transform("top", lambda x: x["word"]).alias("ref_words"), F.when(F.col("words") > 0, shares).alias("ref_word_p"), _normal(classes).alias("ref_class_p"))


def _normal(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.transform(counts, lambda x: x / total))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (square root of the divergence in bits) of two histograms of equal length."""
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2))


def judge(docs: DataFrame) -> DataFrame:
    """Base counts, base_failed, both distances and kept for every document.

    Null text counts as empty (no word, so it fails the base rule of 50
    words). A language with LEAST_SHARE of the documents and a word has a
    reference of its own; all others, and a null language, are held against
    the pool, since histograms of few documents say little. Ties among common
    words go to the smaller word. Equal rows get equal verdicts; very long
    texts are judged whole; extra columns, whatever their names, are ignored;
    an empty table gives an empty result.
    """
    found = stored(references(docs), "language-references")
    total = found.where(F.col("lang_key") == POOLED).select(F.col("docs").alias("total"))
    # At most 1 / LEAST_SHARE languages and the pooled row pass this filter, so the broadcast is bounded.
    kept_refs = found.join(F.broadcast(total)).where((F.col("lang_key") == POOLED) | ((F.col("lang_key") != NULL) & (F.col("docs") >= LEAST_SHARE * F.col("total")) & F.col("ref_words").isNotNull())).drop("docs", "total")
    known = kept_refs.select(F.col("lang_key"), F.col("lang_key").alias("ref_key"), "ref_words", "ref_word_p", "ref_class_p")
    own = measured(docs).join(F.broadcast(known.where(F.col("lang_key") != POOLED)), "lang_key", "left")
    pool = known.where(F.col("lang_key") == POOLED).select(F.col("ref_words").alias("pool_words"), F.col("ref_word_p").alias("pool_word_p"), F.col("ref_class_p").alias("pool_class_p"))
    held = own.join(F.broadcast(pool)).select(
        "doc_id", "words", "n_words", "n_chars", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes",
        F.coalesce("ref_words", "pool_words").alias("ref_words"), F.coalesce("ref_word_p", "pool_word_p").alias("ref_word_p"), F.coalesce("ref_class_p", "pool_class_p").alias("ref_class_p"),
    )
    # The words of all references, at most COMMON_WORDS for each of their few rows: a hash set sorts out most words of a text.
    any_word = sorted(r[0] for r in known.select(F.explode("ref_words")).distinct().collect())
    known_words = held.withColumn("common", F.filter("words", lambda w: w.isin(any_word) & F.array_contains("ref_words", w))).drop("words")
    counts = F.transform("ref_words", lambda t: F.size(F.filter("common", lambda w: w == t)).cast("double"))
    binned = known_words.withColumn("bins", F.concat(counts, F.array((F.col("n_words") - F.size("common")).cast("double")))).drop("common", "ref_words")
    distances = binned.withColumn("class_distance", js_distance(_normal(F.col("classes")), F.col("ref_class_p"))).withColumn("word_distance", js_distance(_normal(F.col("bins")), F.col("ref_word_p")))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    far = ((F.col("n_chars") >= LEAST_CHARS) & (F.col("class_distance") > CLASS_LIMIT)) | ((F.col("n_words") >= LEAST_WORDS) & (F.col("word_distance") > WORD_LIMIT))
    return distances.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & ~F.coalesce(far, F.lit(False))).alias("kept"), "class_distance", "word_distance")
