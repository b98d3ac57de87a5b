"""Quality rules: a threshold table compiled into one projection of built-in functions.

The measures are word, symbol, stop-word and line counts; each rule bounds one ratio of two of them in
per cent. No rule needs a user function, so a plan of this operator has one scan and projections only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillbase.llm.common import SPACE_CLASS

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"

# Frequent function words by language.
STOP_WORDS = {
    "en": "a an and are as at be by for from had has have he her his in is it its not of on or she that the their "
    "they this to was were which who will with you",
    "fr": "au aux avec ce ces cette dans de des du elle elles en est et il ils je la le les leur mais ne nous on ou par "
    "pas plus pour qu que qui sa se ses son sur un une vous",
    "de": "aber als am an auch auf aus bei bin bis das dass dem den der des die du ein eine einem einen einer er es "
    "für hat ich ihr im in ist mit nach nicht noch oder sein sich sie sind so über um und uns von vor war was wie "
    "wir zu zum zur",
    "es": "al como con cuando de del donde el ella en entre era es esta este fue ha hay la las lo los más me mi muy no "
    "nos o para pero por que se ser si sin sobre son su sus también te tiene un una y ya",
}
#: All of them, small and with a capital: texts of one language quote others.
ALL_STOP_WORDS = sorted({f(w) for words in STOP_WORDS.values() for w in words.split() for f in (str, str.capitalize)})


@dataclass(frozen=True)
class Rule:
    """``low`` <= 100 * measure / of <= ``high``, judged for texts of ``from_words`` words or more and, if ``listed``, only in
    languages that have stop words."""

    name: str
    measure: str
    of: str
    low: int | None = None
    high: int | None = None
    from_words: int = 0
    listed: bool = False


RULES = (
    Rule("mean word length", "word_chars", "n_words", low=200, high=2000),
    Rule("symbols per word", "n_symbols", "n_words", high=30),
    Rule("capitals per letter", "n_capitals", "word_chars", high=40),
    Rule("stop words per word", "n_stop_words", "n_words", low=5, from_words=50, listed=True),
    Rule("repeated lines per line", "n_dup_lines", "n_lines", high=50),
)


def compile_rules(rules: Sequence[Rule]) -> Column:
    """One Boolean column: every rule holds. Integer arithmetic, so no rounding decides a tie."""
    verdict = F.lit(True)
    for rule in rules:
        share, of = F.col(rule.measure) * 100, F.col(rule.of)
        holds = F.lit(True)
        if rule.low is not None:
            holds = holds & (share >= of * rule.low)
        if rule.high is not None:
            holds = holds & (share <= of * rule.high)
        holds = holds if not rule.from_words else (F.col("n_words") < rule.from_words) | holds
        verdict = verdict & (holds | ~F.col("listed") if rule.listed else holds)
    return verdict


def measure(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), lang_col: str | None = None) -> DataFrame:
    """The measures of every whole text; a null text is treated as empty.

    Each ``select`` names an array that later ones use more than once, so it is computed once. Windows
    are compared by 64-bit hashes within one text; positions are sorted only in texts that repeat one.
    """
    gap, word = f"[{SPACE_CLASS}]+", f"[^{SPACE_CLASS}]"
    kept = [F.col(c) for c in keep]
    listed = F.coalesce(F.col(lang_col).isin(*STOP_WORDS), F.lit(False)) if lang_col else F.lit(True)
    df = documents.select(*kept, F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), listed.alias("listed"))
    df = df.select(*kept, "_id", "listed", "_text", F.array_remove(F.split("_text", gap), "").alias("_words"), F.split("_text", "\n").alias("_lines"))
    df = df.select(
        *kept,
        "_id",
        "listed",
        "_words",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("_text", "[^A-ZÀ-ÖØ-Þ]+", "")).cast("long").alias("n_capitals"),
        F.filter("_lines", lambda x: x.rlike(word)).alias("_full"),
        F.size(F.filter("_words", lambda w: w.isin(ALL_STOP_WORDS))).cast("long").alias("n_stop_words"),
    )
    df = df.withColumns(
        {
            "n_lines": F.size("_full").cast("long"),
            "n_dup_lines": (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long"),
            "_hashes": F.when(
                F.col("n_words") > WINDOW,
                F.transform(F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, F.lit(WINDOW)))),
            ),
        }
    ).drop("_full", "_words")
    df = df.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_hashes")) < F.size("_hashes"),
            F.sort_array(F.transform("_hashes", lambda x, i: F.struct(x.alias("hash"), i.alias("at")))),
        ),
    ).drop("_hashes")
    same = lambda e, k: F.get("_sorted", k)["hash"].eqNullSafe(e["hash"])
    df = df.withColumn(
        "_places",
        F.sort_array(F.transform(F.filter("_sorted", lambda e, k: ((k > 0) & same(e, k - 1)) | same(e, k + 1)), lambda e: e["at"])),
    ).drop("_sorted")
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    step = lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last"))
    repeats = F.coalesce(F.aggregate("_places", start, step, lambda a: a["n"]), F.lit(0)).cast("long")
    return df.withColumn("n_repeat_words", repeats).drop("_places").withColumnRenamed("_id", id_col if id_col not in keep else "_id")


def quality_rules(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES, keep: Sequence[str] = (), lang_col: str | None = "lang") -> DataFrame:
    """One row per input row: ``id_col``, the measures, ``base_failed`` and ``kept``.

    The stop-word rule is judged in languages that have stop words here; without a column ``lang_col``, or with None, every
    text is taken for one of those.

    ``base_failed``: fewer than 20 words, or more than 30 per cent of the words stand in 8-word windows
    found twice or more. ``kept``: not base_failed, and every rule holds. A null or empty text has no
    words and fails. Null ids and repeated rows are judged like any other row; further columns of the
    input are ignored unless ``keep`` names them; an empty table gives an empty table.
    """
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    lang = lang_col if lang_col in documents.columns else None
    # the partition number keeps a filter above this projection: moved below, it would repeat every measure for each use
    kept = ~F.col("base_failed") & compile_rules(rules) & (F.spark_partition_id() >= 0)
    return measure(documents, id_col, text_col, keep, lang).withColumn("base_failed", base).withColumn("kept", kept)


def keep_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES, lang_col: str | None = "lang") -> DataFrame:
    """The input rows, all columns, that the rules keep; no shuffle."""
    names = documents.columns
    held = documents.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), F.col(id_col).alias("_key"), F.col(text_col).alias("_body"), (F.col(f"`{lang_col}`") if lang_col in names else F.lit("en")).cast("string").alias("_lang"))
    return quality_rules(held, "_key", "_body", rules, keep=("_row",), lang_col="_lang").where("kept").select("_row.*")
