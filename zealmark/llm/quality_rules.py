"""Quality rules as a short-circuit cascade, ordered by what they reject for what they cost.

Every rule says of a text whether it is rejected.  The verdict is that of all
rules together, so their order changes nothing but the work: a text is tested no
further than its first rejecting rule.  The order comes from a sample: what each
rule rejects is counted there for all rules together, its cost is timed there,
and the next rule is always the one that rejects most of the rows still standing
for the least time.

All of it is Spark expressions; no text leaves the JVM.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zealmark.session import stage

# Words stand between space, tab and the line breaks of ASCII.
SPACES = r"[\x20\x09-\x0D]+"
# A window of the repetition rule, in words
WINDOW = 8
# Rows of the sample that orders the rules (expected number); results do not depend on it
SAMPLE_ROWS = 2000


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row, however often and wherever ``use`` reads it."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES, -1), lambda word: word != "")


def lines_of(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def count_where(items: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(items, test)).cast("bigint")


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words that lie in a window of ``width`` words found twice or more in the text, the first one included.

    Windows are told apart by 64-bit hashes; windows of equal hash are compared
    word by word.  Texts without two equal hashes, nearly all, end there.  The
    others sort their windows, so the work is n log n for a text of any length.
    """
    zero = F.lit(0).cast("bigint")

    def covered(starts: Column) -> Column:
        steps = F.zip_with(F.slice(starts, 2, F.size(starts) - 1), F.slice(starts, 1, F.size(starts) - 1), lambda b, a: F.least(F.lit(width), b - a))
        return F.when(F.size(starts) == 0, zero).otherwise(F.aggregate(steps, F.lit(width).cast("bigint"), lambda total, step: total + step))

    def repeats(order: Column) -> Column:
        def same(a: Column, b: Column) -> Column:
            return (a["hash"] == b["hash"]) & (F.slice(words, a["at"] + 1, width) == F.slice(words, b["at"] + 1, width))

        def found(window: Column, place: Column) -> Column:
            before = (place > 0) & same(F.get(order, place - 1), window)
            after = (place + 1 < F.size(order)) & same(F.get(order, place + 1), window)
            return F.when(F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False)), window["at"])

        starts = F.array_sort(F.filter(F.transform(order, found), lambda at: at.isNotNull()))
        return let(starts, covered)

    def of_windows(hashes: Column) -> Column:
        order = F.array_sort(F.transform(hashes, lambda value, at: F.struct(value.alias("hash"), at.alias("at"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), zero).otherwise(let(order, repeats))

    def of_words(hashed: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(hashed) - width)
        windows = F.transform(starts, lambda at: F.xxhash64(*[F.get(hashed, at + k) for k in range(width)]))
        return F.when(F.size(hashed) <= width, zero).otherwise(let(windows, of_windows))

    return let(F.transform(words, lambda word: F.xxhash64(word)), of_words)


# The figures of a text, in the order in which one may use another: each from the text and the figures before it.
FIGURES: dict[str, Callable[[dict[str, Column]], Column]] = {
    "words": lambda of: words_of(of["text"]),
    "lines": lambda of: lines_of(of["text"]),
    "n_words": lambda of: F.size(of["words"]).cast("bigint"),
    "word_chars": lambda of: F.length(F.array_join(of["words"], "")).cast("bigint"),
    "n_symbols": lambda of: F.regexp_count(of["text"], F.lit(r"[#*$%&|<>]")).cast("bigint"),
    "n_lines": lambda of: F.size(of["lines"]).cast("bigint"),
    "n_dup_lines": lambda of: (F.size(of["lines"]) - F.size(F.array_distinct(of["lines"]))).cast("bigint"),
    "n_repeat_words": lambda of: repeated_words(of["words"]),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Rule(NamedTuple):
    """``rejects`` makes the condition from the figures of a text."""

    name: str
    rejects: Callable[[dict[str, Column]], Column]


def _letters(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{L}"))


# The two rules of the base.
BASE_RULES = (
    Rule("few words", lambda of: of["n_words"] < 20),
    Rule("repeated windows", lambda of: 100 * of["n_repeat_words"] > 30 * of["n_words"]),
)
# Bounds in common use for web text.
RULES = (
    Rule("word length", lambda of: (of["word_chars"] < 3 * of["n_words"]) | (of["word_chars"] > 10 * of["n_words"])),
    Rule("symbols", lambda of: 10 * of["n_symbols"] > of["n_words"]),
    Rule("duplicate lines", lambda of: 10 * of["n_dup_lines"] > 3 * of["n_lines"]),
    Rule("words without letter", lambda of: 10 * count_where(of["words"], lambda word: ~word.rlike(r"\p{L}")) > 2 * of["n_words"]),
    Rule("capitals", lambda of: 2 * F.regexp_count(of["text"], F.lit(r"\p{Lu}")) > _letters(of["text"])),
    Rule("stutter", lambda of: 5 * count_where(F.zip_with(F.slice(of["words"], 2, F.greatest(F.size(of["words"]) - 1, F.lit(0))), of["words"], lambda b, a: a == b), lambda same: same) > of["n_words"]),
    Rule("trailing dots", lambda of: 10 * count_where(of["lines"], lambda line: line.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*\z")) > 3 * of["n_lines"]),
    Rule("bullets", lambda of: 10 * count_where(of["lines"], lambda line: line.rlike(r"\A[\x20\x09-\x0D]*[-*•●][\x20\x09-\x0D]")) > 9 * of["n_lines"]),
    Rule("placeholder", lambda of: F.contains(F.lower(of["text"]), F.lit("lorem ipsum"))),
)


class Ordered(NamedTuple):
    """A rule as the sample saw it: the share of rows that it rejected of those still standing, and its seconds a row."""

    rule: Rule
    rejected: float
    seconds: float


def figures(of_text: Column, known: Sequence[str] = ()) -> dict[str, Column]:
    """Every figure: a column where ``known`` has its name, else its expression."""
    out = {"text": of_text}
    for name, make in FIGURES.items():
        out[name] = F.col(f"`{name}`") if name in known else make(out)
    return out


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with the words, the lines and the base figures as columns; a null text is empty."""
    out = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    out = out.withColumns({"words": words_of(F.col("text")), "lines": lines_of(F.col("text"))})
    known = ["words", "lines"]
    rest = figures(F.col("text"), known)
    return out.withColumns({name: rest[name] for name in FIGURES if name not in known})


def order_rules(sample: DataFrame, rules: Sequence[Rule], of: dict[str, Column], repeats: int = 2) -> list[Ordered]:
    """``rules`` by rejection per cost over ``sample``, a stored frame of bounded size.

    One job counts which rules reject together (at most a row for each sample row
    comes back); then each rule is timed alone, less what reading the sample takes.
    An empty sample keeps the given order.
    """
    names = [f"r{k}" for k in range(len(rules))]
    tests = [F.coalesce(rule.rejects(of), F.lit(False)).alias(name) for name, rule in zip(names, rules)]
    patterns = [(tuple(row)[:-1], row["rows"]) for row in sample.select(*tests).groupBy(*names).agg(F.count(F.lit(1)).alias("rows")).collect()]
    rows = sum(count for _, count in patterns)
    if not rows:
        return [Ordered(rule, 0.0, 0.0) for rule in rules]

    def seconds(test: Column) -> float:
        best = float("inf")
        for _ in range(repeats):
            began = time.perf_counter()
            sample.agg(F.count_if(test)).collect()
            best = min(best, time.perf_counter() - began)
        return best

    idle = seconds(F.col("doc_id").isNull())
    # a rule that is too quick to be told from the reading of the sample costs a little all the same
    costs = [max(seconds(rule.rejects(of)) - idle, 0.01 * idle) / rows for rule in rules]
    left, out = list(range(len(rules))), []
    while left:
        standing = sum(count for _, count in patterns) or 1
        shares = {k: sum(count for hit, count in patterns if hit[k]) / standing for k in left}
        best = max(left, key=lambda k: (shares[k] / costs[k], -costs[k]))
        out.append(Ordered(rules[best], shares[best], costs[best]))
        patterns = [(hit, count) for hit, count in patterns if not hit[best]]
        left.remove(best)
    return out


def sampled(docs: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 11) -> DataFrame:
    """About ``rows`` rows of ``docs`` (all where there are no more), stored."""
    there = docs.count()
    share = min(1.0, rows / there) if there else 1.0
    return stage(docs.sample(False, share, seed) if share < 1 else docs, "quality-sample")


def cascade(order: Sequence[Ordered], of: dict[str, Column]) -> Column:
    """Whether a text passes: tested rule by rule, no further than the first that rejects it."""
    verdict: Column | None = None
    for step in order:
        test = step.rule.rejects(of)
        verdict = F.when(test, F.lit(False)) if verdict is None else verdict.when(test, F.lit(False))
    return F.lit(True) if verdict is None else verdict.otherwise(F.lit(True))


def judge_quality(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The base figures of every text and whether it is kept.

    One row for each row of ``docs``: ``doc_id``, the columns of BASE,
    ``base_failed`` and ``kept``.  Null and empty texts have no words and fail the
    base.  Repeated rows and null ids are judged like any other row; further
    columns, of whatever name, are left out.  An empty table gives no rows.
    """
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    known = list(FIGURES)
    of = figures(F.col("text"), known)
    order = order_rules(stage(measured(sampled(narrow, sample_rows)), "quality-figures"), rules, of)
    full = measured(narrow)
    base = F.lit(False)
    for rule in BASE_RULES:
        base = base | rule.rejects(of)
    return full.select("doc_id", *BASE, base.alias("base_failed"), F.when(base, F.lit(False)).otherwise(cascade(order, of)).alias("kept"))


def keep_good(docs: DataFrame, rules: Sequence[Rule] = (*BASE_RULES, *RULES), text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` whose text no rule rejects, with all their columns.

    Here nothing but the verdict is wanted, so the dear rules of the base stand in
    the cascade like the others.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    narrow = docs.select(F.lit(0).alias("doc_id"), text.alias("text"))
    order = order_rules(sampled(narrow, sample_rows), rules, figures(F.col("text")))
    return docs.where(cascade(order, figures(text)))
