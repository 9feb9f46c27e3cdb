"""Quality rules with adaptive thresholds, in DataFrame functions alone.

Each document gets counts (words, symbols, repeated lines and phrases) and from them four ratios. KLL
quantile sketches summarise every ratio for each (language, source), whatever its size. A threshold is an
outer fence of its group, quartile plus ``REACH`` interquartile ranges, where a range counts as ``SPREAD`` at least so that a
group of like documents rejects none of them. The thresholds are joined back and filter the documents.

A null text has no words and fails the base rule; null languages and sources are groups like others; each
row is judged by itself, repeated rows too. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, stored

MIN_WORDS = 50
REACH = 3.0
#: Ratio: the least interquartile range that counts.
SPREAD = {"symbols": 0.03, "dup_lines": 0.10, "repeats": 0.12, "word_chars": 0.50}
SKETCH_K = 400


def _let(value: Column, body) -> Column:
    """``body(x)`` with x bound to ``value``, which is then evaluated once."""
    return F.transform(F.array(value), body)[0]


def _phrase_words(words: str, n: Column) -> Column:
    """Words in windows of three that occur twice or more; equal windows have equal hashes, so most texts end there."""
    at = F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0)))
    hashes = F.transform(at, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    phrases = F.array_sort(F.transform(at, lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("p"), i.alias("i"))))

    def covered(p: Column) -> Column:
        twice = F.filter(p, lambda x, j: F.get(p, j - 1)["p"].eqNullSafe(x["p"]) | F.get(p, j + 1)["p"].eqNullSafe(x["p"]))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    alike = _let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when((n >= 4) & alike, _let(phrases, covered)).otherwise(F.lit(0))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    raw = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), text.alias("text"))
    split = raw.withColumn("words", F.filter(F.split("text", SPACE + "+"), lambda w: w != "")).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size("words")
    return split.select(
        "doc_id", "lang", "source",
        n.cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("text", SPACE + "+", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _phrase_words("words", n).cast("long").alias("n_repeat_words"),
    )


def ratios() -> dict[str, Column]:
    words = F.greatest("n_words", F.lit(1))
    return {"symbols": F.col("n_symbols") / words, "dup_lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)), "repeats": F.col("n_repeat_words") / words, "word_chars": F.col("word_chars") / words}


def thresholds(measured: DataFrame) -> DataFrame:
    """lang, source, low_<ratio> and high_<ratio>: a row for each group of the table."""
    by = measured.select("lang", "source", *[c.cast("double").alias(k) for k, c in ratios().items()])
    own = by.groupBy("lang", "source").agg(*[F.kll_sketch_agg_double(k, F.lit(SKETCH_K)).alias(k) for k in SPREAD])
    out = ["lang", "source"]
    for k, least in SPREAD.items():
        q1, q3 = (F.kll_sketch_get_quantile_double(F.col(k), F.lit(q)) for q in (0.25, 0.75))
        reach = F.greatest(q3 - q1, F.lit(least)) * REACH
        out += [(q1 - reach).alias(f"low_{k}"), (q3 + reach).alias(f"high_{k}")]
    return own.select(*out)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and the rules that failed."""
    measured = stored(measures(docs, id_col, text_col, lang_col, source_col), "measures")  # the texts are read once
    limits = thresholds(measured).withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # Long words are a fault on either side; of the other ratios only excess is.
    broken = [F.when((c > F.col(f"high_{k}")) | ((c < F.col(f"low_{k}")) if k == "word_chars" else F.lit(False)), F.lit(k)) for k, c in ratios().items()]
    judged = measured.join(limits, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source"))).withColumn("failed_rules", F.concat_ws(",", *broken))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & (F.col("failed_rules") == "")).alias("kept"), "failed_rules")
