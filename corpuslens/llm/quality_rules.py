"""Quality rules as a short-circuit cascade, in DataFrame functions only."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import scan, stored, unused_name

#: Rows, at most, on which costs and selectivities are estimated. They decide the order of the rules, never a verdict.
SAMPLE_ROWS = 500
_SPACE = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), _SPACE), "")


def word_chars(words: Column) -> Column:
    return F.char_length(F.array_join(words, "")).cast("long")


def n_symbols(text: Column) -> Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    return (F.octet_length(text) - F.octet_length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long")


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def n_dup_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def windows(words: Column) -> Column:
    """A hash of each three words in a row."""
    first = F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0)))
    return F.transform(first, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))


def n_repeat_words(hashes: Column, ordered: Column, places: Column) -> Column:
    """Words in windows found twice or more: from the places of such windows, each covering three words."""
    gaps = F.transform(places, lambda p, i: F.least(F.coalesce(F.get(places, i + 1) - p, F.lit(3)), F.lit(3)))
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda total, gap: total + gap)
    return F.when(F.size(places) > 0, covered).otherwise(F.lit(0).cast("long"))


def repeated_places(ordered: Column) -> Column:
    """Ascending places of the windows whose hash a neighbour in the order by hash shares."""
    shared = F.filter(ordered, lambda w, i: (F.get(ordered, i - 1)["h"] == w["h"]) | (F.get(ordered, i + 1)["h"] == w["h"]))
    return F.sort_array(F.transform(shared, lambda w: w["i"]))


@dataclass(frozen=True)
class Rule:
    """A reason to reject: measures(row) adds columns of its own in steps, rejects(row) reads them."""

    name: str
    measures: tuple[tuple[str, Callable[[str, str], Column]], ...]
    rejects: Callable[[Callable[[str], Column]], Column]


def _hashes_in_order(words: str) -> Column:
    """Windows by hash, if any repeats; most texts repeat none and are spared the sort."""
    hashes = F.col(words)
    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(pairs))


# Measures by name: how each is computed from the text column and from measures before it.
_WORDS = ("words", lambda text, at: words_of(F.col(text)))
_N_WORDS = ("n_words", lambda text, at: F.size(at("words")).cast("long"))
_CHARS = ("word_chars", lambda text, at: word_chars(at("words")))
_SYMBOLS = ("n_symbols", lambda text, at: n_symbols(F.col(text)))
_LINES = ("lines", lambda text, at: worded_lines(F.col(text)))
_N_LINES = ("n_lines", lambda text, at: F.size(at("lines")).cast("long"))
_DUP_LINES = ("n_dup_lines", lambda text, at: n_dup_lines(at("lines")))
_HASHES = ("hashes", lambda text, at: windows(at("words")))
_ORDERED = ("ordered", lambda text, at: _hashes_in_order(at.name("hashes")))
_PLACES = ("places", lambda text, at: repeated_places(at("ordered")))
_REPEATS = ("n_repeat_words", lambda text, at: n_repeat_words(at("hashes"), at("ordered"), at("places")))

BASE = [
    Rule("few_words", (_WORDS, _N_WORDS), lambda at: at("n_words") < 50),
    Rule("repeated_words", (_WORDS, _N_WORDS, _HASHES, _ORDERED, _PLACES, _REPEATS), lambda at: 100 * at("n_repeat_words") > 50 * at("n_words")),
]
FURTHER = [
    Rule("symbols", (_WORDS, _N_WORDS, _SYMBOLS), lambda at: 10 * at("n_symbols") > at("n_words")),
    Rule("short_words", (_WORDS, _N_WORDS, _CHARS), lambda at: at("word_chars") < 2 * at("n_words")),
    Rule("long_words", (_WORDS, _N_WORDS, _CHARS), lambda at: at("word_chars") > 15 * at("n_words")),
    Rule("repeated_lines", (_LINES, _N_LINES, _DUP_LINES), lambda at: 100 * at("n_dup_lines") > 50 * at("n_lines")),
]


class _At:
    """Columns of the measures, under names that clash with none of the table's."""

    def __init__(self, df: DataFrame):
        self.columns, self.names = df.columns, {}

    def name(self, measure: str) -> str:
        if measure not in self.names:
            self.names[measure] = unused_name(f"_{measure}", [*self.columns, *self.names.values()])
        return self.names[measure]

    def __call__(self, measure: str) -> Column:
        return F.col(self.name(measure))


def _measured(df: DataFrame, rules: list[Rule], at: _At, text: str, unless: Column | None = None) -> DataFrame:
    """The rules' measures, one projection each; rows for which `unless` holds get nulls and cost nothing."""
    for rule in rules:
        for measure, of in rule.measures:
            if at.name(measure) not in df.columns:
                value = of(text, at)
                df = df.withColumn(at.name(measure), value if unless is None else F.when(~unless, value))
    return df


def ordered_rules(docs: DataFrame, rules: list[Rule], text: str = "text") -> list[Rule]:
    """The rules by rejections per second, estimated on a few rows; ties by name.

    Each rule runs alone over the same rows: its time against a run that only reads them is its cost, the share it
    rejects its selectivity.
    """
    rows = stored(docs.select(text).limit(SAMPLE_ROWS), "rule-sample")

    def run(rule: Rule | None) -> tuple[float, int]:
        at = _At(rows)
        measured = _measured(rows, [rule] if rule else [], at, text)
        rejected = F.sum(F.when(rule.rejects(at), 1).otherwise(0)) if rule else F.sum(F.octet_length(text))
        start = time.perf_counter()
        found = measured.agg(rejected).first()[0]
        return time.perf_counter() - start, found or 0

    run(None)
    floor = run(None)[0]
    worth = {}
    for rule in rules:
        seconds, rejected = run(rule)
        worth[rule.name] = rejected / max(seconds - floor, 1e-4)
    return sorted(rules, key=lambda rule: (-worth[rule.name], rule.name))


def cascade(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """The rows that no rule rejects, with their own columns.

    The rules run in the order of rejections per cost; each is a filter on what the ones before have left, so a
    rejected row costs nothing further. Null and empty texts have no words; rows with nulls elsewhere, repeated rows and columns of any name
    pass through; an empty table gives no rows.
    """
    columns = docs.columns
    at, df = _At(docs), docs
    for rule in ordered_rules(docs, rules if rules is not None else BASE + FURTHER, text):
        # A filter that names the task's number stays above the measures; else the optimiser would repeat them inside it.
        here = at.name(f"task_{rule.name}")
        df = _measured(df, [rule], at, text).withColumn(here, F.spark_partition_id())
        df = df.where(~F.coalesce(rule.rejects(at), F.lit(False)) & (F.col(here) >= 0))
    return df.select(*[F.col(f"`{c}`") for c in columns])


def graded(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept.

    The base measures are due for all rows; the further rules are tried in their order only where the base did not
    fail and no rule before has rejected.
    """
    at = _At(docs)
    order = ordered_rules(docs, FURTHER, text)
    df = _measured(docs, [*BASE, *FURTHER[:2]], at, text)
    df = _measured(df, [FURTHER[3]], at, text)
    failed = unused_name("_failed", [*df.columns])
    df = df.withColumn(failed, BASE[0].rejects(at) | BASE[1].rejects(at))
    verdict = F.when(F.col(failed), False)
    for rule in order:
        verdict = verdict.when(rule.rejects(at), False)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    added = [*[at(n).alias(n) for n in names], F.col(failed).alias("base_failed"), verdict.otherwise(True).alias("kept")]
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in {*names, "base_failed", "kept"}]
    return df.select(*kept, *added)


def op4_quality_rules(spark, sf_dir):
    return graded(scan(spark, sf_dir, "documents", "doc_id", "text")).drop("text")


#: The same in SQL.
OP4_SQL = r"""
with w as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
  from documents
), lines as (
  select r, len(l) as n_lines, len(l) - len(list_distinct(l)) as n_dup_lines
  from (select r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from w)
), windows as (
  select r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as t
  from (select r, words, unnest(range(1, len(words) - 1)) as i from w where len(words) > 2)
), repeated as (
  select r, count(distinct p) as n_repeat_words
  from (select r, unnest([i, i + 1, i + 2]) as p from windows where (r, t) in (select (r, t) from windows group by r, t having count(*) > 1))
  group by r
), stats as (
  select doc_id, len(words) as n_words, coalesce(length(array_to_string(words, '')), 0) as word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
    n_lines, n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
  from w join lines using (r) left join repeated using (r)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or 10 * n_symbols > n_words or word_chars < 2 * n_words
    or word_chars > 15 * n_words or 100 * n_dup_lines > 50 * n_lines) as kept
from stats
"""
