"""Quality rules: a threshold table compiled into Spark projections, without user functions.

Words are the maximal runs without white space (space, ASCII 9 to 13), counted
over the whole text in its own case. Defined results for edge cases: a null or
empty text has no words, so every count is 0 and ``base_failed`` is true; ties
and repeated rows are judged row by row, and a ratio on a threshold passes; an
empty table gives an empty table; very long texts are measured whole, in arrays
of their words; further columns are passed through only by ``keep_documents``,
whatever their names. Repeats of three-word windows are found by 64-bit hashes within a text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import SPACES

SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it for was on be with as by this are from or an at which "
    "der die das und ist nicht ein eine zu den mit von auf für im dem des sich als auch "
    "le la les de des et un une en est que qui dans pour du il au par sur pas "
    "el los las del y es por con una para se no lo su al como más pero"
).split()


@dataclass(frozen=True)
class Rule:
    """``numerator / denominator`` must lie within [low, high]; None leaves a side open."""

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None

    def passed(self) -> Column:
        ratio = F.expr(f"CAST({self.numerator} AS DOUBLE) / NULLIF({self.denominator}, 0)")
        sides = [ratio >= self.low] * (self.low is not None) + [ratio <= self.high] * (self.high is not None)
        out = F.lit(True)
        for side in sides:
            out = out & side
        return F.coalesce(out, F.lit(False))


#: The threshold table. Ratios are meant to reject text of no use and to leave plain prose of any length alone.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 25.0),
    Rule("symbols", "n_symbols", "n_words", None, 0.1),
    Rule("capitals", "n_capitals", "word_chars", None, 0.4),
    Rule("exclamations", "n_exclamations", "n_words", None, 0.5),
    Rule("stop_words", "n_stop_words", "n_words", 0.01, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.3),
    Rule("line_length", "n_words", "n_lines", 2.0, None),
)


def _without(column: str, characters: str) -> Column:
    return F.translate(F.col(column), characters, "")


def _measured(df: DataFrame) -> DataFrame:
    """Adds the counts to a table of (__row, __text)."""
    inner = F.btrim("__text", F.lit(SPACES))
    df = df.select("__row", F.coalesce("__text", F.lit("")).alias("__text")).select(
        "*",
        F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "[ \\t\\n\\x0B\\f\\r]+")).alias("__words"),
        F.filter(F.split("__text", "\n"), lambda x: _without_var(x) != "").alias("__lines"),
        F.length("__text").alias("__length"),
    )
    n = F.size("__words")
    df = df.select(
        "*",
        F.when(
            n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2)))
        ).alias("__windows"),
    )
    repeated = F.size(F.array_distinct("__windows")) < F.size("__windows")
    df = df.select("*", F.when(repeated, F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("__sorted"))
    again = F.filter(
        "__sorted", lambda p, i: ((i > 0) & (F.get("__sorted", i - 1)["h"] == p["h"])) | F.coalesce(F.get("__sorted", i + 1)["h"] == p["h"], F.lit(False))
    )
    covered = F.aggregate(
        F.array_sort(F.transform(again, lambda p: p["i"])),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, i: F.struct((i + 3).alias("end"), (acc["n"] + F.least(F.lit(3), i + 3 - acc["end"])).alias("n")),
        lambda acc: acc["n"],
    )
    letters = "".join(map(chr, range(65, 91)))
    return df.select(
        "__row",
        n.cast("long").alias("n_words"),
        F.length(_without("__text", SPACES)).cast("long").alias("word_chars"),
        (F.col("__length") - F.length(_without("__text", SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.col("__length") - F.length(_without("__text", letters))).cast("long").alias("n_capitals"),
        (F.col("__length") - F.length(_without("__text", "!"))).cast("long").alias("n_exclamations"),
        F.size(F.filter("__words", lambda w: F.lower(w).isin(*dict.fromkeys(STOP_WORDS)))).cast("long").alias("n_stop_words"),
    )


def _without_var(x: Column) -> Column:
    return F.translate(x, SPACES, "")


def _judged(df: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    verdict = F.lit(True)
    for rule in rules:
        verdict = verdict & rule.passed()
    failed = F.filter(F.array(*[F.when(~r.passed(), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    kept = ~base & verdict
    return df.select("*", base.alias("base_failed"), kept.alias("kept"), failed.alias("failed_rules"))


def measure(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: its keys, the counts, ``base_failed``, ``kept`` and the names of the rules it fails."""
    packed = docs.select(F.struct(*keys).alias("__row"), F.col(text).alias("__text"))
    return _held(_judged(_measured(packed), rules)).select("__judged.__row.*", *[F.col(f"__judged.{c}") for c in _OUT])


def keep_documents(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with all their columns."""
    packed = docs.select(F.struct("*").alias("__row"), F.col(text).alias("__text"))
    return _held(_judged(_measured(packed), rules)).filter("__judged.kept").select("__judged.__row.*")


def _held(judged: DataFrame) -> DataFrame:
    """The rows as a struct ``__judged`` that filters stay above.

    A filter is not pushed through a generator. Without one it would go through the projections, which would write
    their steps into one another and repeat them for each element of an array.
    """
    return judged.select(F.explode(F.array(F.struct("*"))).alias("__judged"))


_OUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_capitals", "n_exclamations", "n_stop_words", "failed_rules")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(*(c for c in ("doc_id", *_OUT[:7])))


def _sql() -> str:
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    tests = []
    for r in RULES:
        ratio = f"(CAST({r.numerator} AS DOUBLE) / NULLIF({r.denominator}, 0))"
        tests += [f"{ratio} >= {r.low}"] * (r.low is not None) + [f"{ratio} <= {r.high}"] * (r.high is not None)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
a AS (SELECT rid, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
w AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM a),
g AS (SELECT rid, i, word || ' ' || lead(word) OVER p || ' ' || lead(word, 2) OVER p AS tri FROM w WINDOW p AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, tri) AS n FROM g WHERE tri IS NOT NULL) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS o(k) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
      CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines,
      length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals, length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclamations,
      len(list_filter(ws, lambda x: list_contains([{stops}], lower(x)))) AS n_stop_words
      FROM d JOIN a USING (rid) LEFT JOIN c USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce({" AND ".join(tests)}, false) AS kept FROM b"""


ORACLE_SQL = _sql()
