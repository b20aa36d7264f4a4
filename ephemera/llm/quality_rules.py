"""Quality rules with risk-controlled cut-offs, on built-in Spark functions alone.

Fixed rules reject short and repetitive texts.  Further signals (larger is worse) get a cut-off per stratum from
labelled good rows: a cut-off is *certified* if an exact binomial test shows that it rejects at most the allowed share
of good texts, at a level divided by the number of all tests (strata x signals x cut-offs).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ephemera.llm.common import checkpointed

#: Word separators: space and U+0009 to U+000D.
_SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Cut-offs that are tested for each signal, in ascending order (fixed before any data are seen).
GRID = {
    "symbol_share": [0.01, 0.02, 0.05, 0.1, 0.2],
    "dup_line_share": [0.1, 0.2, 0.3, 0.5, 0.7],
    "repeat_share": [0.1, 0.2, 0.3, 0.4, 0.45],
    "upper_share": [0.1, 0.2, 0.3, 0.5, 0.8],
    "same_word_share": [0.4, 0.5, 0.6, 0.75, 0.9],
    "mark_share": [0.05, 0.1, 0.15, 0.2, 0.3],
}
RISK = 0.03  # share of good texts that all signals together may reject in a stratum
LEVEL = 0.05  # chance that any certified cut-off is wrong


def repeat_words(words: Column, n: Column) -> Column:
    """Sorted (hash, place) of the 3-word windows of ``words``."""
    windows = F.transform(F.slice(words, F.lit(1), n - 2), lambda w, i: F.struct(F.xxhash64(w, words[i + 1], words[i + 2]).alias("h"), i.alias("i")))
    return F.when(n >= 3, F.sort_array(windows))


def text_signals(docs: DataFrame, text_col: str, keep: dict[str, Column]) -> DataFrame:
    """``keep`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, n_distinct and n_marks of every text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    line_word = "[^\\x20\\x09-\\x0D]"
    split = docs.select(*(c.alias(k) for k, c in keep.items()), text.alias("t"), F.array_remove(F.split(text, _SPACE), "").alias("w"))
    split = split.select(
        *keep, "w", F.size("w").cast("long").alias("n_words"), F.array_join("w", "").alias("j"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(line_word)).alias("lines"),
    )
    without = lambda chars: (F.char_length("j") - F.char_length(F.translate("j", chars, ""))).cast("long")
    split = split.select(
        *keep,
        "n_words",
        F.char_length("j").cast("long").alias("word_chars"),
        without(SYMBOLS).alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        without("!?*|#<>$%&=~^_{}[]").alias("n_marks"),
        repeat_words(F.col("w"), F.size("w")).alias("s"),
    )
    s, last = F.col("s"), F.size("s") - 1
    # places of windows whose neighbour in hash order is the same window
    places = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < last) & (F.get(s, i + 1)["h"] == x["h"])))
    places = F.sort_array(F.transform(places, lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate(
        places, start, lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + p + 3 - F.greatest(a["end"], p)).alias("n")), lambda a: a["n"].cast("long")
    )
    names = [c for c in split.columns if c != "s"]
    return split.select(*names, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def log_binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """log P(X <= k) for X ~ Binomial(n, p), by summing terms in logs from 0 to ``k``."""
    odds = math.log(p / (1 - p))
    zero = F.struct((n * math.log1p(-p)).alias("term"), (n * math.log1p(-p)).alias("total"))

    def add(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) / i) + F.lit(odds)
        big, small = F.greatest(a["total"], term), F.least(a["total"], term)
        return F.struct(term.alias("term"), (big + F.log1p(F.exp(small - big))).alias("total"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.expr("cast(array() as array<bigint>)"))
    return F.aggregate(steps, zero, add, lambda a: a["total"])


def _signals() -> Column:
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    values = {
        "symbol_share": F.col("n_symbols") / chars,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
        "upper_share": F.col("n_upper") / chars,
        "same_word_share": 1 - F.col("n_distinct") / words,
        "mark_share": F.col("n_marks") / chars,
    }
    return F.array(*(values[name] for name in GRID))


def certified_cutoffs(labelled: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """(stratum, cutoffs): per signal the certified cut-off with the best balance of rejected bad and good rows, null if there is none.

    ``labelled`` has stratum, signals (array in the order of GRID) and quality; only counts per stratum, signal and
    grid interval are gathered.  The balance is the share of bad rows rejected less five times that of good ones; of
    equals the largest cut-off is taken, and none that rejects no bad row.
    """
    grid = F.array(*(F.array(*map(F.lit, cuts)) for cuts in GRID.values()))
    each = labelled.select("stratum", "quality", F.posexplode("signals").alias("signal", "value"))
    # how many cut-offs the value exceeds
    over = F.size(F.filter(F.get(grid, F.col("signal")), lambda c: F.col("value") > c))
    counts = each.groupBy("stratum", "signal", over.alias("over")).agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    strata = counts.select("stratum").distinct().count()
    tests = max(1, strata * sum(map(len, GRID.values())))
    steps = len(next(iter(GRID.values())))
    spread = counts.select("stratum", "signal", "good", "bad", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("cut"), "over")
    by_cut = spread.groupBy("stratum", "signal", "cut").agg(
        F.sum("good").alias("n"),
        F.sum("bad").alias("n_bad"),
        F.sum(F.when(F.col("over") > F.col("cut"), F.col("good")).otherwise(0)).alias("k"),
        F.sum(F.when(F.col("over") > F.col("cut"), F.col("bad")).otherwise(0)).alias("hits"),
    )
    share = risk / len(GRID)
    # beyond the expected count the test cannot succeed, so the sum stays short
    sure = F.when(F.col("k") < F.col("n") * share, log_binomial_cdf(F.col("k"), F.col("n"), share) <= math.log(level / tests)).otherwise(False)
    best = by_cut.where(sure & (F.col("hits") > 0)).groupBy("stratum", "signal").agg(F.max(F.struct(F.expr("hits / n_bad - 5 * k / n"), "cut")).alias("best"))
    best = best.select("stratum", "signal", F.get(F.get(grid, F.col("signal")), F.col("best.cut")).alias("value"))
    per = best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("signal", "value"))).alias("m"))
    return per.select("stratum", F.array(*(F.element_at("m", F.lit(i)) for i in range(len(GRID)))).alias("cutoffs"))


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    stratum_col: str = "lang",
    label_col: str = "quality",
    label_id_col: str = "doc_id",
    risk: float = RISK,
    level: float = LEVEL,
) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by) for every row.

    Words are runs without ASCII white space.  base_failed: fewer than 50 words, or over half of them in 3-word
    windows that the text repeats.  kept: not base_failed, and no signal above its certified cut-off in the stratum.
    Texts are read once, whole; signals (numbers only) are checkpointed, so fitting does not read them again.

    Null text has no words; a null stratum is the stratum ''; rows without a usable label only do not help to fit;
    repeated labels count repeatedly; with too few labels no cut-off is certified and the fixed rules decide alone; an
    empty table gives an empty result.  Windows are compared by 64-bit hashes.
    """
    keep = {"doc_id": F.col(id_col), "stratum": F.coalesce(F.col(stratum_col).cast("string"), F.lit(""))}
    signals = checkpointed(text_signals(docs, text_col, keep).withColumn("signals", _signals()))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    signals = signals.withColumn("base_failed", base)
    known = labels.select(F.col(label_id_col).alias("doc_id"), F.col(label_col).alias("quality")).where("quality in (0, 1)")
    cutoffs = certified_cutoffs(signals.where(~base).join(known, "doc_id"), risk, level)
    judged = signals.join(cutoffs, "stratum", "left")
    names = F.array(*map(F.lit, GRID))
    over = F.filter(F.arrays_zip("signals", "cutoffs", names.alias("name")), lambda x: x["signals"] > x["cutoffs"])
    rejected = F.coalesce(F.transform(over, lambda x: x["name"]), F.expr("cast(array() as array<string>)"))
    out = judged.withColumn("rejected_by", rejected)
    kept = ~F.col("base_failed") & (F.size("rejected_by") == 0)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "rejected_by")


