"""Quality rules as a short-circuit cascade, in SQL functions only.

Each rule is a boolean expression over the text that says "reject". Its cost (seconds a row)
and selectivity (share of rows rejected) are measured on a bounded sample; the cascade then
tries the rules in falling order of rejection per cost and stops at the first that rejects. The
order never changes the verdict, only the work.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Scratch, read

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
#: Expected rows of the random sample on which costs and selectivities are measured.
SAMPLE_ROWS = 1000
#: Seconds a row below which a cost can't be told from a job's own time.
LEAST_COST = 2e-5


@dataclass(frozen=True)
class Rule:
    """A name and an SQL expression over ``text`` that is true for rows to reject."""

    name: str
    reject: str


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; none for null."""
    return F.coalesce(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""), F.array().cast("array<string>"))


def word_chars(text: Column) -> Column:
    """Code points outside ASCII white space."""
    return F.coalesce(F.char_length(F.translate(text, SPACE, "")), F.lit(0)).cast("long")


def symbols(text: Column) -> Column:
    return F.coalesce(F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, "")), F.lit(0)).cast("long")


def lines(text: Column) -> Column:
    """The \\n-split lines that have a word."""
    return F.coalesce(F.filter(F.split(text, "\n"), lambda line: F.length(F.btrim(line, F.lit(SPACE))) > 0), F.array().cast("array<string>"))


def duplicate_lines(lines: Column) -> Column:
    """Lines that equal an earlier line."""
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed a single time: it becomes a lambda's variable."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows found twice or more in the text, the first one included.

    Windows are compared by 64-bit hash within one text; a hash's positions are neighbours once
    the (hash, position) pairs are sorted, so a text costs n log n and never leaves its row.
    """

    def windows(w: Column) -> Column:
        at = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))

    def twice(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        return F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1))["i"]

    def covered(p: Column) -> Column:
        shifted = [p, F.transform(p, lambda i: i + 1), F.transform(p, lambda i: i + 2)]
        return F.size(F.array_distinct(F.concat(*shifted)))

    positions = _once(F.sort_array(windows(words)), twice)
    return F.coalesce(_once(positions, covered), F.lit(0)).cast("long")


#: Each metric over the columns ``text``, ``words`` and ``lines``.
METRICS = {
    "n_words": lambda c: F.size(c("words")).cast("long"), "word_chars": lambda c: word_chars(c("text")), "n_symbols": lambda c: symbols(c("text")),
    "n_dup_lines": lambda c: duplicate_lines(c("lines")), "n_repeat_words": lambda c: repeated_words(c("words")),
}
LINES = {"n_lines": lambda c: F.size(c("lines")).cast("long")}


#: The base rules, over metrics; a rule that needs fewer metrics costs less.
BASE = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
)
#: Further production rules: odd word lengths, symbols, repeated lines.
PRODUCTION = (
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", "n_dup_lines >= 3 AND 3 * n_dup_lines > n_lines"),
)


def _metrics(column) -> dict[str, Column]:
    return {name: f(column) for name, f in (METRICS | LINES).items()}


def _reject(rule: Rule, metrics: dict[str, Column]) -> Column:
    """The rule with each metric's expression put in place, so that nothing else is computed."""
    pairs = [v.alias(k) for k, v in metrics.items() if k in rule.reject.replace("*", " ").split()]
    test = _once(F.struct(*pairs), lambda m: _over(rule.reject, m, list(metrics)))
    return F.coalesce(test, F.lit(False))


def _over(sql: str, m: Column, names: list[str]) -> Column:
    """A rule's small grammar (``a * b > c AND ...``) over the fields of ``m``."""

    def atom(token: str) -> Column:
        return m[token] if token in names else F.lit(int(token)).cast("long")

    def product(side: str) -> Column:
        tokens = [t.strip() for t in side.split("*")]
        out = atom(tokens[0])
        for t in tokens[1:]:
            out = out * atom(t)
        return out

    out = None
    for part in sql.split(" AND "):
        for sign in (">=", "<=", ">", "<"):
            if f" {sign} " in part:
                a, b = (product(x) for x in part.split(f" {sign} "))
                test = {">=": a >= b, "<=": a <= b, ">": a > b, "<": a < b}[sign]
                break
        else:
            raise ValueError(f"a rule needs a comparison: {sql}")
        out = test if out is None else out & test
    return out


def sample(docs: DataFrame, rows: int, scratch: Scratch, text_col: str) -> DataFrame:
    """About ``rows`` rows of ``docs`` picked at random from all of it, saved: (text, words, lines)."""
    n = docs.count()
    some = docs.sample(min(1.0, rows / max(n, 1)), seed=7) if n > rows else docs
    text = F.col(text_col)
    return scratch.save(some.select(text.alias("text"), words(text).alias("words"), lines(text).alias("lines")))


def measure(sample: DataFrame, rules: tuple[Rule, ...], metrics: dict[str, Column]) -> list[tuple[Rule, float, float]]:
    """(rule, seconds a row, share rejected) on a saved sample; only counts come to the driver.

    The time of reading the sample is taken off. What a rule costs beyond it is that of the
    metrics as they are given: expressions that are computed, or columns that are there already.
    """
    out = []

    def timed(test: Column) -> tuple[float, int, int]:
        began = time.perf_counter()
        n, rows = sample.agg(F.count_if(test), F.count("*")).first()
        return time.perf_counter() - began, n, max(1, rows)

    nothing = F.col("text").isNull() & F.col("words").isNull() & F.col("lines").isNull()
    timed(nothing)
    reading = timed(nothing)[0]
    for rule in rules:
        took, n, rows = timed(_reject(rule, metrics))
        out.append((rule, max(LEAST_COST, (took - reading) / rows), n / rows))
    return out


def order(measured: list[tuple[Rule, float, float]]) -> list[Rule]:
    """Most rejection per cost first; a rule that rejected nothing comes last, cheapest first."""
    return [r for r, cost, share in sorted(measured, key=lambda m: (-m[2] / max(m[1], 1e-9), m[1]))]


def cascade(rules: list[Rule], metrics: dict[str, Column]) -> Column:
    """The first rule that rejects, else null; later branches aren't evaluated for that row."""
    out = None
    for rule in rules:
        test = _reject(rule, metrics)
        out = F.when(test, F.lit(rule.name)) if out is None else out.when(test, F.lit(rule.name))
    return F.lit(None).cast("string") if out is None else out


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = BASE + PRODUCTION, text_col: str = "text") -> DataFrame:
    """The rows that no rule rejects, with all their columns.

    Null and empty texts have no words, so the base rules reject them. Texts of any length are
    judged whole, and repeated rows alike. An empty table gives an empty table. Columns may have
    any name.
    """
    scratch = Scratch(docs.sparkSession)
    some = sample(docs, SAMPLE_ROWS, scratch, text_col)
    ordered = order(measure(some, tuple(rules), _metrics(F.col)))
    scratch.drop(some)
    # words are split once, as nearly every rule needs them; lines only where a rule comes to them
    text = F.col(text_col)

    def rejected_by(w: Column) -> Column:
        return cascade(ordered, _metrics({"text": text, "words": w, "lines": lines(text)}.__getitem__))

    return docs.where(_once(words(text), rejected_by).isNull())


def judge(docs: DataFrame, rules: tuple[Rule, ...] = PRODUCTION, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's metrics, ``base_failed`` and ``kept``, null and repeated rows included.

    As all metrics are asked for, the rules run over columns that are there; the cascade stops
    at the base rules, then at the first rule that rejects. Null ids are ids like others; texts
    of any length are read whole; an empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession)
    cheap = {name: F.col(name) for name in METRICS | LINES}
    text = F.col(text_col)
    some = sample(docs, SAMPLE_ROWS, scratch, text_col)
    known = scratch.save(some.select("text", "words", "lines", *[v.alias(k) for k, v in _metrics(F.col).items()]))
    ordered = order(measure(known, tuple(rules), cheap))
    scratch.drop(some, known)
    base = F.coalesce(cascade(list(BASE), cheap).isNotNull(), F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), words(text).alias("words"), lines(text).alias("lines"))
    rows = rows.select("id", *[v.alias(k) for k, v in _metrics(F.col).items()])
    return rows.select(F.col("id").alias(id_col), *METRICS, base.alias("base_failed"), (~base & cascade(ordered, cheap).isNull()).alias("kept"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
m AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS n_symbols, len(lines) AS n_lines,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines FROM d),
g AS (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
t AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM t) GROUP BY doc_id),
a AS (SELECT m.*, coalesce(c.n, 0) AS n_repeat_words FROM m LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_symbols > 3 * n_words
            OR n_dup_lines >= 3 AND 3 * n_dup_lines > n_lines) AS kept
FROM b"""

QUERIES = {"op3_quality_rules": op3_quality_rules}
ORACLES = {"op3_quality_rules": SQL}
