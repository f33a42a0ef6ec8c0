"""Per-document text features as column expressions over whole texts.

Counts come from one regular-expression pass each, so no token list is built
for features that only need a number. Lexicon features join a token table with
a lexicon (see ``operators.lexicon``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
SENTENCE = r"[^.!?]*[^.!?\s][^.!?]*"
WORD = r"\S+"
VOWEL = "aeiouyàâäáãåæèéêëìíîïòóôöõœùúûüÿ"

# Common English function words; pass another list for other languages.
FUNCTION_WORDS = [
    "a", "about", "after", "all", "also", "am", "an", "and", "any", "are", "as", "at", "be", "because", "been",
    "before", "being", "between", "both", "but", "by", "can", "could", "did", "do", "does", "down", "during",
    "each", "few", "for", "from", "had", "has", "have", "he", "her", "here", "him", "his", "how", "i", "if", "in",
    "into", "is", "it", "its", "me", "more", "most", "my", "no", "nor", "not", "of", "off", "on", "only", "or",
    "other", "our", "out", "over", "own", "same", "she", "so", "some", "such", "than", "that", "the", "their",
    "them", "then", "there", "these", "they", "this", "those", "through", "to", "too", "under", "until", "up",
    "very", "was", "we", "were", "what", "when", "where", "which", "while", "who", "why", "will", "with", "you", "your",
]


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"\S")


def tokens(text: Column) -> Column:
    """Lower-case alphanumeric tokens."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def whitespace_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def num_sentences(text: Column) -> Column:
    """Non-blank stretches between sentence marks, at least one."""
    return F.greatest(F.regexp_count(text, F.lit(SENTENCE)), F.lit(1))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(a.cast("double") / F.nullif(b, F.lit(0)), F.lit(0.0))


def syllables(lower_text: Column, num_words: Column) -> Column:
    """Vowel groups, at least one per token; groups cannot cross token borders."""
    groups = F.regexp_count(lower_text, F.lit(f"[{VOWEL}]+"))
    voiced = F.regexp_count(lower_text, F.lit(rf"[\p{{L}}\p{{N}}&&[^{VOWEL}]]*[{VOWEL}][\p{{L}}\p{{N}}]*"))
    return groups + num_words - voiced


def complex_words(tok: Column) -> Column:
    """Tokens with three vowel groups or more."""
    return F.size(F.filter(tok, lambda t: t.rlike(f"(?:[{VOWEL}]+[^{VOWEL}]+){{2}}[{VOWEL}]")))


def function_words(tok: Column, words: list[str]) -> Column:
    return F.size(F.filter(tok, lambda t: t.isin(*words)))


def counts(df: DataFrame, text: str = "text", words: list[str] | None = None) -> DataFrame:
    """Add the raw counts that the style features share."""
    df = df.withColumn("_lower", F.lower(text)).withColumn("_tok", F.regexp_extract_all("_lower", F.lit(TOKEN), F.lit(0)))
    df = df.withColumns({
        "_n": F.size("_tok"), "_u": F.size(F.array_distinct("_tok")), "_s": num_sentences(F.col(text)),
        "_c": F.length(F.replace(F.col(text), F.lit(" "), F.lit(""))), "_x": complex_words(F.col("_tok")),
        "_f": function_words(F.col("_tok"), words or FUNCTION_WORDS),
    })
    return df.withColumn("_y", syllables(F.col("_lower"), F.col("_n"))).drop("_lower")


def style_features(df: DataFrame, text: str = "text", words: list[str] | None = None) -> DataFrame:
    """The column-only style features; a blank text has zeros."""
    c = counts(df, text, words)
    n, s = F.col("_n"), F.col("_s")
    blank = is_blank(F.col(text))
    wps, spw = n / s, ratio(F.col("_y"), n)
    out = {
        "num_words": n.cast("bigint"),
        "word_diversity": ratio(F.col("_u"), n),
        "average_word_length": ratio(F.col("_c"), n),
        "avg_sentence_length": wps.cast("double"),
        "function_word_ratio": ratio(F.col("_f"), n),
        "content_word_ratio": F.when(n > 0, 1.0 - ratio(F.col("_f"), n)).otherwise(1.0),
        "flesch_reading_ease": 206.835 - 1.015 * wps - 84.6 * spw,
        "gunning_fog": 0.4 * (wps + 100.0 * ratio(F.col("_x"), n)),
    }
    zero = {k: F.when(blank, F.lit(0).cast("bigint") if k == "num_words" else F.lit(0.0)).otherwise(v) for k, v in out.items()}
    return c.withColumns(zero).drop("_tok", "_n", "_u", "_s", "_c", "_x", "_f", "_y")


def legacy_features(df: DataFrame, text: str = "text", words: list[str] | None = None) -> DataFrame:
    """Earlier feature set: letters only, zeros below ten words, +1e-5 denominators.

    Letters-only text has no sentence marks, so it counts as one sentence.
    """
    eps = 1e-5
    df = df.withColumn("_lt", F.trim(F.regexp_replace(F.regexp_replace(text, r"[^a-zA-Z\s]", " "), r"\s+", " ")))
    df = df.withColumn("_w", F.filter(F.split("_lt", " "), lambda t: t != ""))
    df = df.withColumn("_lo", F.transform("_w", lambda t: F.lower(t)))
    df = df.withColumns({
        "_n": F.size("_w"), "_u": F.size(F.array_distinct("_w")), "_f": function_words(F.col("_lo"), words or FUNCTION_WORDS),
        "_x": complex_words(F.col("_lo")),
    }).withColumn("_y", syllables(F.lower("_lt"), F.col("_n")))
    n = F.col("_n")
    wps = n / (F.lit(1) + eps)
    out = {
        "num_words": n.cast("double"), "avg_sentence_length": wps, "word_diversity": F.col("_u") / (n + eps),
        "flesch_reading_ease": 206.835 - 1.015 * n - 84.6 * ratio(F.col("_y"), n),
        "gunning_fog": 0.4 * (n + 100.0 * ratio(F.col("_x"), n)),
        "function_word_ratio": F.col("_f") / (n + eps), "content_word_ratio": 1.0 - F.col("_f") / (n + eps),
    }
    return df.withColumns({k: F.when(n < 10, 0.0).otherwise(v) for k, v in out.items()}).drop(
        "_lt", "_w", "_lo", "_n", "_u", "_f", "_x", "_y")


def clean_output(text: Column) -> Column:
    """Trim and drop one leading '>'."""
    t = F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"^>\s*", "")
    return t
