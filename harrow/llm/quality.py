"""Quality rules: a table of thresholds compiled into one projection, without user functions.

Every ratio is a Column over the text; the verdict is the conjunction of one comparison per threshold row. Rows are never
shuffled, and a text of any length is handled in its own row.

Cases: a null or empty text has no words and fails the base rule (fewer than 10 words); repeated rows get equal
verdicts; other columns, whatever their names, are passed through ``judge`` untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import SPACES, WORD, let, table

#: Function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that for it was on be with as by are this from or "
    "de la le les et des en un une du que qui dans pour est pas sur au par avec "
    "der die und den von zu das mit sich des auf ist im dem nicht ein eine für als auch "
    "el los las del se por con no su al lo como más"
).split()


@dataclass(frozen=True)
class Threshold:
    """A ratio, the bound it is held against, and whether the bound is a least or a most value."""

    ratio: str
    bound: float
    least: bool = False


#: The verdict's rules. One is added to the stop words, so that a short clean text without any passes. Bounds follow the labelled documents: clean ones stay within each by a wide margin.
RULES = (
    Threshold("mean_word_length", 2.0, least=True),
    Threshold("mean_word_length", 20.0),
    Threshold("symbol_ratio", 0.3),
    Threshold("stop_word_ratio", 0.02, least=True),
    Threshold("dup_line_ratio", 0.45),
)


def measures(text: Column) -> Column:
    """A struct of counts over one text: words, their code points, symbols, lines with a word, repeated ones, words in repeated windows, stop words."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(WORD))
    stop = [F.lit(w) for w in STOP_WORDS]
    return let(
        F.filter(F.split(whole, SPACES, -1), lambda w: w != ""),
        lambda words: F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.regexp_replace(whole, SPACES, "")).cast("long").alias("word_chars"),
            F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            F.size(lines).cast("long").alias("n_lines"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(*stop))).cast("long").alias("n_stop_words"),
        ),
    )


def covered_words(windows: Column) -> Column:
    """Words that lie in one of the windows found twice or more."""
    ordered = F.sort_array(F.transform(windows, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    again = let(
        ordered,
        lambda s: F.filter(
            F.transform(
                s,
                lambda x, k: F.when(
                    F.coalesce(F.get(s, k - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["g"] == x["g"], F.lit(False)), x["i"]
                ),
            ),
            lambda i: i.isNotNull(),
        ),
    )
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(-1).alias("end"))
    return F.aggregate(
        F.sort_array(again),
        start,
        lambda acc, p: F.struct((acc["total"] + F.lit(5) - F.greatest(acc["end"] - p, F.lit(0))).alias("total"), (p + 5).alias("end")),
        lambda acc: acc["total"],
    )


def repeated_words(words: Column) -> Column:
    """Words covered by a 5-word window that occurs twice or more; windows are compared by a 64-bit hash of five word hashes."""
    windows = let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: F.slice(
            F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, 5)])),
            1,
            F.greatest(F.size(h) - 4, F.lit(0)),
        ),
    )
    return let(windows, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered_words(g)))


def ratios(m: Column) -> dict[str, Column]:
    words = F.greatest(m["n_words"], F.lit(1))
    return {
        "mean_word_length": m["word_chars"] / words,
        "symbol_ratio": m["n_symbols"] / words,
        "stop_word_ratio": (m["n_stop_words"] + 1) / words,
        "dup_line_ratio": m["n_dup_lines"] / F.greatest(m["n_lines"], F.lit(1)),
    }


def verdict(m: Column, rules=RULES) -> Column:
    """The threshold table as one boolean Column."""
    of, good = ratios(m), F.lit(True)
    for r in rules:
        good = good & (of[r.ratio] >= r.bound if r.least else of[r.ratio] <= r.bound)
    return good


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


def judge(docs: DataFrame, text: str = "text", into: str = "quality", rules=RULES) -> DataFrame:
    """Add one struct column: the counts, ``base_failed`` and ``kept``. A column of that name is replaced."""
    found = let(measures(F.col(f"`{text}`")), lambda m: F.struct(m.alias("m"), base_failed(m).alias("base_failed"), (~base_failed(m) & verdict(m, rules)).alias("kept")))
    # explode of a one-element array: the optimizer does not copy a generator's input into each later use of its field
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != into], F.explode(F.array(found)).alias(into))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("quality")
    counts = [q["m"][c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judge(table(spark, sf_dir, "documents")).select("doc_id", *counts, q["base_failed"].alias("base_failed"), q["kept"].alias("kept"))


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)

#: Counts of every document; shared with the pipeline's SQL.
COUNTS_SQL = rf"""
w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
n AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))::BIGINT AS n_lines,
    (n_lines - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    len(list_filter(ws, lambda x: lower(x) IN ({_STOP})))::BIGINT AS n_stop_words
  FROM w),
g AS (SELECT doc_id, i, ws[i:i+4] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n_repeat_words FROM twice, range(0, 5) AS s(k) GROUP BY doc_id),
m AS (SELECT n.*, coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words FROM n LEFT JOIN r USING (doc_id)),
v AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
    (word_chars / greatest(n_words, 1) >= 2.0 AND word_chars / greatest(n_words, 1) <= 20.0 AND n_symbols / greatest(n_words, 1) <= 0.3
      AND (n_stop_words + 1) / greatest(n_words, 1) >= 0.02 AND n_dup_lines / greatest(n_lines, 1) <= 0.45) AS good
  FROM m)
"""

OP4_SQL = f"""WITH {COUNTS_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND good) AS kept FROM v"""
