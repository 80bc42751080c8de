"""Quality rules on document statistics and on divergence from language references.

Only DataFrame functions: every statistic is an expression of one row, so scoring has no shuffle.
The references are medians and sums over all documents of each language, a table of one row of
fixed width a language; medians keep junk in the corpus out of the character classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.base import WS, WS_RUN, cut, text_of

#: Frequent function words of four languages.
COMMON_WORDS = (
    "the of and to in a is that it for was with as on be by at this are or from "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch "
    "le la les et des du un une est que qui dans pour par sur pas au ce il en "
    "el los las de y una por con para se del lo su al como más no"
).split()
#: Characters of the contract's n_symbols.
SYMBOLS = "[#*$%&|<>]"
#: A median of fewer documents is no reference: these are left to the base rules.
MIN_DOCS = 5
#: Up to so many references (about 1 KB each) go to every worker; beyond it they are joined by a shuffle.
BROADCAST_LANGS = 10_000
#: Guards: shorter texts are not judged by that histogram.
MIN_CHARS, MIN_COMMON_WORDS, MIN_MARKS = 200, 80, 10
#: Largest Jensen-Shannon distances (base 2, 0 to 1) to the reference of the language.
MAX_CLASS_DISTANCE, MAX_MARK_DISTANCE = 0.35, 0.50
#: The largest distances of the common words (which ones, and their share of all words) come from
#: the language's accepted documents: upper quartile plus so many quartile ranges, and at least
#: what chance alone gives a text of MIN_COMMON_WORDS words.
FENCE, LEAST_WORD_LIMIT, LEAST_SHARE_LIMIT = 6.0, 0.5, 0.15
#: Base rules of the contract.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

CLASSES = ("lower", "upper", "digit", "space", "symbol", "other", "beyond_ascii")
#: Classes of the histogram of marks: symbols and other punctuation.
MARKS = (CLASSES.index("symbol"), CLASSES.index("other"))


def _without(col: Column, what: str) -> Column:
    return F.regexp_replace(col, what, "")


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_words``, the base statistics and the two histograms to each row.

    Null and empty texts have no words and zero everywhere. Any length is handled in
    O(n log n); repeated rows are judged each for itself."""
    t = text_of(docs, text)
    df = docs.withColumn("_t", t).withColumn("_bare", F.btrim(F.col("_t"), F.lit(WS)))
    df = df.withColumn("_words", F.when(F.col("_bare") == "", F.array().cast("array<string>")).otherwise(F.split("_bare", WS_RUN)))
    df = df.withColumn("_black", _without(F.col("_t"), WS_RUN))
    df = df.withColumn("_plain", _without(F.col("_black"), "[a-z]+"))
    df = df.withColumn("_odd", _without(F.col("_plain"), SYMBOLS + "+"))
    df = df.withColumn("_lines", F.filter(F.split("_t", "\n", -1), lambda x: F.btrim(x, F.lit(WS)) != ""))
    n = F.size("_words")
    # windows by a 64-bit hash of their three words; equal hashes within one text mean equal windows
    df = df.withColumn(
        "_win",
        F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)))).otherwise(
            F.array().cast("array<bigint>")
        ),
    )
    df = df.withColumn(
        "_sorted",
        F.when(F.size(F.array_distinct("_win")) < F.size("_win"), F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(
            F.array().cast("array<struct<h:bigint,i:int>>")
        ),
    )
    s, size = F.col("_sorted"), F.size("_sorted")
    twice = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < size - 1) & (F.get(s, k + 1)["h"] == x["h"])))
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    n_black, n_all = F.length("_black"), F.length("_t")
    plain, odd = F.length("_plain"), F.length("_odd")
    upper = odd - F.length(_without(F.col("_odd"), "[A-Z]+"))
    digit = odd - F.length(_without(F.col("_odd"), "[0-9]+"))
    beyond = odd - F.length(_without(F.col("_odd"), "[^\\x00-\\x7F]+"))
    common = F.filter(F.split(F.lower("_t"), "[^\\p{L}]+"), lambda w: w.isin(COMMON_WORDS))
    df = df.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": n_black.cast("long"),
            "n_symbols": (plain - odd).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.when(size == 0, 0).otherwise(F.size(covered)).cast("long"),
            "_classes": F.array(
                *(c.cast("double") for c in (n_black - plain, upper, digit, n_all - n_black, plain - odd, odd - upper - digit - beyond, beyond))
            ),
            "_common": common,
            # not deterministic, so no filter is pushed below: there it would repeat the
            # expressions above once for each element of an array
            "_row": F.monotonically_increasing_id(),
        }
    )
    found, total = F.size("_common"), F.greatest(F.col("n_words"), F.size("_common"))
    # each found word stands between spaces of its own, so removing one word shows its count
    df = df.withColumn("_found", F.concat(F.lit(" "), F.array_join("_common", "  "), F.lit(" ")))
    gone = lambda w: F.octet_length("_found") - F.octet_length(F.replace(F.col("_found"), F.concat(F.lit(" "), w, F.lit(" ")), F.lit("")))
    counts = F.array(*((gone(F.lit(w)) / (len(w.encode()) + 2)).cast("double") for w in COMMON_WORDS))
    df = df.withColumn("_counts", F.concat(counts, F.array((total - found).cast("double"))))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", F.when(F.col("_row") >= 0, base)).drop("_row", "_t", "_bare", "_black", "_plain", "_odd", "_lines", "_win", "_sorted", "_common", "_found", "_words")


def language_references(stats: DataFrame, lang: str = "lang") -> DataFrame:
    """_lang, _ref_classes, _ref_counts, _ref_marks: shares of each language over all its documents that pass
    the base rules: medians of class shares and mark shares, sums of common words. Null is no
    language; every other one with MIN_DOCS such documents has a row."""
    n_words = len(COMMON_WORDS) + 1
    total = F.aggregate("_classes", F.lit(0.0), lambda a, x: a + x)
    stats = stats.withColumn("_total", total)
    marks = F.col("_classes")[MARKS[0]] + F.col("_classes")[MARKS[1]]
    aggs = [F.percentile_approx(F.when(F.col("_total") > 0, F.col("_classes")[i] / F.col("_total")), 0.5, 1000).alias(f"c{i}") for i in range(len(CLASSES))]
    aggs += [F.percentile_approx(F.when(marks >= MIN_MARKS, F.col("_classes")[k] / marks), 0.5, 1000).alias(f"m{i}") for i, k in enumerate(MARKS)]
    aggs += [F.sum(F.col("_counts")[i]).alias(f"w{i}") for i in range(n_words)]
    rows = stats.where(~F.col("base_failed") & F.col(lang).isNotNull()).groupBy(lang).agg(F.count("*").alias("n"), *aggs)

    def shares(c: str, k: int) -> Column:
        v = F.array(*(F.coalesce(F.col(f"{c}{i}"), F.lit(0.0)) for i in range(k)))
        total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
        return F.when(total > 0, F.transform(v, lambda x: x / total)).otherwise(v).alias({"c": "_ref_classes", "w": "_ref_counts", "m": "_ref_marks"}[c])

    return rows.where(F.col("n") >= MIN_DOCS).select(F.col(lang).alias("_lang"), shares("c", len(CLASSES)), shares("w", n_words), shares("m", 2))


def js_distance(shares: Column, reference: list[float] | Column) -> Column:
    """Square root of the Jensen-Shannon divergence in bits between a column of shares and a
    reference. Shares are null for an empty histogram; the distance is then 1."""

    def half(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    against = reference if isinstance(reference, Column) else F.array(*map(F.lit, reference))
    parts = F.zip_with(shares, against, lambda p, q: half(p, (p + q) / 2) + half(q, (p + q) / 2))
    bits = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / 2
    return F.when(shares.isNull(), 1.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), bits)))


def word_limits(measured: DataFrame) -> DataFrame:
    """_lang, _word_limit, _share_limit from the distances of each language's documents that pass
    all other rules and are long enough for the histogram."""
    quart = lambda c: F.percentile_approx(c, [0.25, 0.75], 1000).alias(c)
    rows = measured.where("not base_failed and not _other_bad and _lang is not null").where(F.col("n_words") >= MIN_COMMON_WORDS)
    rows = rows.groupBy("_lang").agg(quart("word_distance"), quart("share_distance"))
    fence = lambda c, least: F.greatest(F.lit(least), F.col(c)[1] + FENCE * (F.col(c)[1] - F.col(c)[0]))
    return rows.select("_lang", fence("word_distance", LEAST_WORD_LIMIT).alias("_word_limit"), fence("share_distance", LEAST_SHARE_LIMIT).alias("_share_limit"))


def _by_language(rows: DataFrame, table: DataFrame, on: Column, name: str) -> DataFrame:
    """Left join with a table of one row a language."""
    table = cut(table, name)
    return rows.join(F.broadcast(table) if table.count() <= BROADCAST_LANGS else table, on, "left")


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", columns: list[str] | None = None) -> DataFrame:
    """Each row of ``docs`` (its ``columns``, by default all) with the base statistics,
    ``base_failed``, ``class_distance``, ``word_distance``, ``share_distance``, ``mark_distance``
    (to the reference of its language, 0 without one) and ``kept``.

    Documents whose language has no reference (null, MIN_DOCS not reached) are decided by the base rules alone.
    Texts under MIN_CHARS characters, MIN_COMMON_WORDS words or MIN_MARKS marks skip that histogram. The
    statistics are computed once and written to the shared folder. Extra columns are
    kept; names that begin with an underscore or equal an added column are replaced."""
    stats = with_statistics(docs, text)
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "_classes", "_counts"]
    columns = docs.columns if columns is None else columns
    stats = stats.select(*(c for c in columns if not c.startswith("_") and c not in added), F.col(lang).alias("_of"), *added)
    stats = cut(stats, "quality-statistics")
    refs = language_references(stats, "_of")
    stats = stats.withColumn("_marks", F.array(*(F.col("_classes")[k] for k in MARKS)))
    for c in ("_classes", "_counts", "_marks"):
        stats = stats.withColumn(f"{c}_sum", F.aggregate(c, F.lit(0.0), lambda a, x: a + x))
    for c in ("_classes", "_counts", "_marks"):
        total = F.col(f"{c}_sum")
        stats = stats.withColumn(c, F.when(total > 0, F.transform(c, lambda x: x / total)))
    out = _by_language(stats, refs, F.col("_of") == F.col("_lang"), "quality-references")
    known = lambda c: (1.0 - c[len(COMMON_WORDS)], c[len(COMMON_WORDS)])
    out = out.withColumn("_share", F.when(F.col("_counts").isNotNull(), F.array(*known(F.col("_counts"))))).withColumn("_ref_share", F.array(*known(F.col("_ref_counts"))))
    for name, c in (("class", "classes"), ("word", "counts"), ("share", "share"), ("mark", "marks")):
        ref = F.col(f"_ref_{c}")
        out = out.withColumn(f"{name}_distance", F.when(F.col("_lang").isNull(), 0.0).otherwise(js_distance(F.col(f"_{c}"), ref)))
    marked = (F.col("_marks_sum") >= MIN_MARKS) & (F.col("mark_distance") > MAX_MARK_DISTANCE)
    out = out.withColumn("_other_bad", marked | ((F.col("word_chars") >= MIN_CHARS) & (F.col("class_distance") > MAX_CLASS_DISTANCE)))
    limits = word_limits(out).withColumnRenamed("_lang", "_limit_of")
    out = _by_language(out, limits, F.col("_lang") == F.col("_limit_of"), "quality-limits")
    far = (F.col("word_distance") > F.coalesce("_word_limit", F.lit(1.0))) | (F.col("share_distance") > F.coalesce("_share_limit", F.lit(1.0)))
    bad = F.col("_other_bad") | ((F.col("n_words") >= MIN_COMMON_WORDS) & far)
    # not deterministic, so a filter on it is not pushed below, where it would repeat the distances
    verdict = F.when(F.monotonically_increasing_id() >= 0, ~F.col("base_failed") & ~bad).otherwise(F.lit(False))
    out = out.withColumn("kept", verdict)
    return out.select(*(c for c in out.columns if not c.startswith("_")))
