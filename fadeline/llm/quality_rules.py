"""Quality rules: distribution divergence from language references. JVM expressions only.

Counting is per row; references are sums over all documents of a language. A document's histograms
of character classes and of common words are compared with its language's by Jensen-Shannon distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fadeline.llm._common import settle

#: The classes of characters, as regular expressions; all others are one more class.
CLASSES = {
    "space": r"[\x20\x09-\x0D]+",
    "upper": r"[A-ZÀÁÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ]+",
    "digit": r"[0-9]+",
    "stop": r"[.,;:!?]+",
    "symbol": r"[#*$%&|<>]+",
}
#: Each language's most common words.
COMMON = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "are", "as", "with", "be", "by", "this", "from", "or", "an", "at"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "est", "qui", "pour", "dans", "par", "sur", "pas", "au", "plus", "elle", "avec"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "es"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al", "lo", "como"],
}
#: One character stands for each common word while they are counted.
_SIGNS = "abcdefghijklmnopqrstuv"
#: A document's characters and common words are held against its reference from so many words on, and
#: fail beyond these distances. Documents farther off than TRIM don't count for the second reference.
LEAST_WORDS, LEAST_COMMON, MOST_CHARS, MOST_WORDS, TRIM = 20, 60, 0.19, 0.32, 0.12
WINDOW = 8


def base_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", row: str | None = None) -> DataFrame:
    """One row per document with the counts that rules and histograms need; a null text has no words.

    ``n_repeat_words``: words in windows of ``WINDOW`` words that occur twice or more. Windows are told
    apart by 64-bit hashes; only documents with a repeated hash are looked at further. Each step
    that is used more than once is a column of its own, so that Spark computes it once.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    out = lambda k: F.length(F.regexp_replace("t", CLASSES[k], ""))
    through = [row] if row else []
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), t.alias("t"), *through)
    rows = rows.select("*", F.length("t").cast("bigint").alias("n_chars"), F.filter(F.split("t", CLASSES["space"]), lambda w: w != "").alias("words"),
                       F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    rows = rows.select("*", F.size("words").cast("bigint").alias("n_words"), F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"))
    starts = F.sequence(F.lit(1), (F.col("n_words") - (WINDOW - 1)).cast("int"))
    signs = F.lit("")
    for code, words in COMMON.items():
        signs = F.when(F.col("lang") == code, _signs(words)).otherwise(signs)
    rows = rows.select(
        "doc_id", "lang", "n_words", "n_chars", "word_chars", signs.alias("signs"), *through,
        *((F.col("n_chars") - out(k)).cast("bigint").alias(f"c_{k}") for k in CLASSES if k != "space"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.col("n_words") > WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).alias("hashes"),
    )
    again = F.coalesce(F.size("hashes") > F.size(F.array_distinct("hashes")), F.lit(False))
    rows = rows.withColumn("pairs", F.when(again, F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    alike = lambda p, j: (F.get(F.col("pairs"), j)["h"] == p["h"])
    at = F.array_sort(F.transform(F.filter("pairs", lambda p, j: ((j > 0) & alike(p, F.greatest(j - 1, F.lit(0)))) | F.coalesce(alike(p, j + 1), F.lit(False))), lambda p: p["i"]))
    covered = F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
                          lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n"), i.alias("last")), lambda s: s["n"])
    return rows.select(
        "doc_id", *through, "lang", "n_words", "word_chars", F.col("c_symbol").alias("n_symbols"), "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"),
        _shares([F.col("n_chars") - F.col("word_chars"), *(F.col(f"c_{k}") for k in CLASSES if k != "space")], F.col("n_chars")).alias("chars"),
        _shares([F.length("signs") - F.length(F.replace("signs", F.lit(x), F.lit(""))) for x in _SIGNS], F.col("n_words")).alias("common"),
    )


def _signs(common: list[str]) -> Column:
    table = F.create_map(*(F.lit(x) for pair in zip(common, _SIGNS, strict=True) for x in pair))
    return F.array_join(F.transform(F.filter("words", lambda w: w.isin(common)), lambda w: F.element_at(table, w)), "")


def _shares(counts: list[Column], total: Column) -> Column:
    """The counts and what is left of the total, as parts of one; all in the last class if there is nothing."""
    of = F.greatest(total, F.lit(1)).cast("double")
    parts = F.array(*(c / of for c in counts))
    return F.concat(parts, F.array(F.lit(1.0) - F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)))


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms (arrays that sum to 1), base 2: from 0 to 1."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    halves = F.zip_with(p, q, lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2)
    return F.sqrt(F.greatest(F.aggregate(halves, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", row: str | None = None) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance, kept[, row]).

    ``row`` names a column that goes through.

    ``base_failed``: under 20 words, or over 30 % of the words in repeated windows. The references
    are means over all documents of a language that pass the base, made twice, the second time without
    those far off the first, and at most five of them: one for
    each language of ``COMMON`` and one for all others (null included), which are held against characters only.
    A document that passes the base is kept if both distances stay within bounds; repeated rows and
    ids are judged row by row. Null and empty texts have no words and fail the base.
    """
    rows = settle(base_counts(docs, doc_id, text, lang, row).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
                  .withColumn("group", F.when(F.col("lang").isin(list(COMMON)), F.col("lang")).otherwise("other")))
    mean = lambda c, n: F.array(*(F.avg(F.col(c)[i]) for i in range(n)))

    def held_against(sound: DataFrame) -> DataFrame:
        reference = sound.groupBy("group").agg(mean("chars", len(CLASSES) + 1).alias("ref_chars"), mean("common", len(_SIGNS) + 1).alias("ref_common"))
        held = rows.join(F.broadcast(reference), "group", "left")  # at most five rows
        held = held.withColumn("char_distance", F.when(F.col("n_words") >= LEAST_WORDS, divergence(F.col("chars"), F.col("ref_chars"))))
        return held.withColumn("word_distance", F.when((F.col("n_words") >= LEAST_COMMON) & (F.col("group") != "other"), divergence(F.col("common"), F.col("ref_common")))).drop("ref_chars", "ref_common")

    held = held_against(held_against(rows.filter("NOT base_failed")).filter(~F.col("base_failed") & (F.col("char_distance") <= TRIM)))
    fine = (F.coalesce("char_distance", F.lit(0.0)) <= MOST_CHARS) & (F.coalesce("word_distance", F.lit(0.0)) <= MOST_WORDS)
    return held.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", (~F.col("base_failed") & fine).alias("kept"), *([row] if row else []))
