"""Quality rules: divergence of a document's histograms from language references, in DataFrame functions only.

Base counts and two histograms are taken from every whole text: character classes, and common words of its language.
References are the mean histograms of all documents of a language. A document is dropped by the method if a histogram
lies further than a limit, in Jensen-Shannon distance, from its reference, or if the two distances together exceed a third
limit; histograms of too few words give no verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.session import cut

#: Common words by language, lower case.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "en": "the of and to in a is that for it as was with be by on not he are this at".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur".split(),
}
#: Languages without a word list, and rows with none, are held against this reference and get no word verdict.
ANY = "*"
CLASSES = ["lower", "upper", "digit", "mark", "symbol", "other", "gap"]
MIN_WORDS_CHARS, MIN_WORDS_COMMON = 20, 60
MAX_CHARS, MAX_COMMON, MAX_SUM = 0.30, 0.45, 0.42
_SPACE = r"[\x20\x09-\x0D]+"


def _count_in(text: str, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(F.col(text), chars, ""))


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs plus _words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the residue column _rest.

    Five-word windows are compared by a 64-bit hash of their words. Work per text is n log n: hashes are put in order
    only where a text repeats one.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.withColumn("_words", F.filter(F.split(t, _SPACE, -1), lambda w: w != ""))
    df = df.withColumns({"n_words": F.size("_words").cast("long"), "_glued": F.array_join("_words", "")})
    df = df.withColumns({"word_chars": F.length("_glued").cast("long"), "_rest": F.regexp_replace("_glued", "[a-z]+", "")}).drop("_glued")
    df = df.withColumn("n_symbols", _count_in("_rest", "#*$%&|<>").cast("long"))
    df = df.withColumn("_lines", F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")

    def window(i: Column) -> Column:
        return F.xxhash64(*[F.get("_words", i + k) for k in range(5)])

    hashes = F.when(F.col("n_words") >= 5, F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 5), window)).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_h", hashes)
    again = F.size(F.array_distinct("_h")) < F.size("_h")
    df = df.withColumn("_s", F.when(again, F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter("_s", lambda x, k: F.coalesce(F.get("_s", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_s", k + 1)["h"] == x["h"], F.lit(False)))
    df = df.withColumn("_p", F.array_sort(F.transform(twice, lambda x: x["i"])))
    run = F.transform("_p", lambda p, k: F.least(F.lit(5), F.coalesce(F.get("_p", k + 1) - p, F.lit(5))))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(run, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0)).cast("long"))
    return df.drop("_h", "_s", "_p")


def _shares(counts: list[Column], whole: Column) -> Column:
    return F.array(*[F.coalesce(F.try_divide(c.cast("double"), whole.cast("double")), F.lit(0.0)) for c in counts])


def histograms(counted: DataFrame, lang_col: str = "lang") -> DataFrame:
    """Adds _key (the reference language), _chars and _common: shares of character classes and of common words."""
    df = counted.withColumns({
        "_upper": _count_in("_rest", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "_digit": _count_in("_rest", "0123456789"),
        "_mark": _count_in("_rest", ".,;:!?'\"()-"),
        "_restlen": F.length("_rest"),
        "_key": F.when(F.col(lang_col).isin(*COMMON_WORDS), F.col(lang_col)).otherwise(F.lit(ANY)),
    })
    other = F.col("_restlen") - F.col("_upper") - F.col("_digit") - F.col("_mark") - F.col("n_symbols")
    parts = [F.col("word_chars") - F.col("_restlen"), F.col("_upper"), F.col("_digit"), F.col("_mark"), F.col("n_symbols"), other, F.col("n_words")]
    df = df.withColumn("_chars", _shares(parts, F.col("word_chars") + F.col("n_words"))).drop("_upper", "_digit", "_mark", "_restlen", "_rest")
    listed = F.coalesce(F.create_map(*[x for k, v in COMMON_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[F.col("_key")], F.array().cast("array<string>"))
    every = sorted({w for v in COMMON_WORDS.values() for w in v})
    df = df.withColumns({"_list": listed, "_low": F.filter(F.transform("_words", lambda w: F.lower(w)), lambda w: w.isin(*every))})
    size = F.size("_low")
    df = df.withColumn("_hits", F.transform("_list", lambda w: size - F.size(F.array_remove("_low", w)))).drop("_low")
    hit = F.aggregate("_hits", F.lit(0), lambda s, x: s + x)
    share = F.transform(F.concat("_hits", F.array(F.col("n_words").cast("int") - hit)), lambda x: F.coalesce(F.try_divide(x.cast("double"), F.col("n_words").cast("double")), F.lit(0.0)))
    return df.withColumn("_common", share).drop("_list", "_hits", "_words")


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two arrays of shares."""

    def part(x: Column, y: Column) -> Column:
        m = (x + y) / 2
        one = lambda v: F.when(v > 0, v * F.log2(v / m)).otherwise(F.lit(0.0))
        return (one(x) + one(y)) / 2

    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(p, q, part), F.lit(0.0), lambda s, x: s + x)))


def references(shares: DataFrame, min_words: int = MIN_WORDS_CHARS) -> DataFrame:
    """Mean histograms by reference language over all documents with enough words: at most one row a word list and one."""
    longest = max(map(len, COMMON_WORDS.values())) + 1
    means = [F.avg(F.col("_chars")[i]).alias(f"c{i}") for i in range(len(CLASSES))] + [F.avg(F.get("_common", F.lit(i))).alias(f"w{i}") for i in range(longest)]
    got = shares.where(F.col("n_words") >= min_words).groupBy("_key").agg(*means)
    words = F.filter(F.array(*[F.col(f"w{i}") for i in range(longest)]), lambda x: x.isNotNull())
    return got.select("_key", F.array(*[F.col(f"c{i}") for i in range(len(CLASSES))]).alias("_ref_chars"), words.alias("_ref_common"))


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_chars: float = MAX_CHARS, max_common: float = MAX_COMMON, max_sum: float = MAX_SUM) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    js_chars, js_common.

    base_failed: under 10 words, or over 20 % of the words in repeated windows. kept: not base_failed and no distance,
    nor their sum, above its limit. A text of under 20 words gets no character verdict and one of under 60 no word verdict; the
    distance is then null. A null text has no words. A null or unlisted language is held against the mean of such rows
    and gets no word verdict. Repeated rows each come back; an empty table gives an empty result; other columns are
    not read.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    shares = cut(histograms(base_counts(narrow, "_text"), "_lang").drop("_text", "_lang"))
    ref = F.broadcast(references(shares))  # at most len(COMMON_WORDS) + 1 rows
    df = shares.join(ref, "_key", "left")
    df = df.withColumns({
        "js_chars": F.when(F.col("n_words") >= MIN_WORDS_CHARS, js_distance(F.col("_chars"), F.col("_ref_chars"))),
        "js_common": F.when((F.col("n_words") >= MIN_WORDS_COMMON) & (F.col("_key") != ANY), js_distance(F.col("_common"), F.col("_ref_common"))),
        "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
    })
    x, y = F.coalesce("js_chars", F.lit(0.0)), F.coalesce("js_common", F.lit(0.0))
    far = (x > max_chars) | (y > max_common) | (x + y > max_sum)
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~far).alias("kept"), "js_chars", "js_common")
