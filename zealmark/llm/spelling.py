"""Words that may be spellings of one another, by composing finite-state machines.

The vocabulary is a minimal acceptor V.  V composed with the transducer of one edit
(one code point inserted, deleted or replaced) and with V again accepts the pairs of
near words.  That machine is cut by its initial states, so that no task holds the vocabulary:

* Two near words, the shorter of length n, agree in their first n // 2 code points
  or else in their last n - n // 2.  Every beginning (read forwards) and every
  ending (read backwards) is a state from which a small machine starts: the
  remainders of the words that reach it.  A task builds the minimal acceptors of
  these remainders, composes them and lists the accepted pairs.
* Pairs are listed at the state of their common beginning; at that of their ending
  only where they do not share the beginning.  So each pair is listed once.
* A state that more than ``MAX_WORDS`` words reach is cut again, by the place of the
  edit and what remains without it: such a part holds one word for each letter of the
  alphabet at most, so no task grows with the vocabulary, and no pair is lost.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zealmark.llm.common import BATCH_ROWS, partitions, prepare
from zealmark.session import stage

# Letters of a word: A-Z, a-z and U+00C0 to U+00FF
RUN = re.compile("[a-zÀ-ÿ]+")
MIN_LENGTH, MIN_COUNT = 5, 3
# One run in so many loses a code point before it is counted (a fixed rule of the data's noise); None: none does.
THIN = 97
# Words at one initial state; beyond it the state is cut again
MAX_WORDS = 5000
# Different words that a task holds before it hands their counts on
HELD_WORDS = 200_000
# What a part of the machine lists: pairs that agree in their beginning, in their ending but not their
# beginning, or (in the parts of a state cut again) replaced or inserted at one place.
BEGINNING, ENDING, REPLACED, INSERTED = range(4)


# --- words and how often they occur ------------------------------------------------------------


def thinned(run: str, crc: int, every: int | None = THIN) -> str:
    """``run`` without the code point that its hash names, if the hash names one."""
    if every is None or crc % every:
        return run
    at = crc % len(run)
    return run[:at] + run[at + 1 :]


def _counts(every: int | None, min_length: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                # bytes.lower changes A-Z alone
                runs = Counter(RUN.findall(text.as_py().encode().lower().decode()))
                before = zlib.crc32(f"{key}:".encode())
                for run, n in runs.items():
                    word = thinned(run, zlib.crc32(run.encode(), before), every)
                    if len(word) >= min_length:
                        held[word] += n
                if len(held) > HELD_WORDS:
                    yield handed()
        yield handed()

    return count


def count_words(docs: DataFrame, id_col: str, text_col: str, every: int | None = THIN, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): every word of the whole texts with its occurrences, of ``min_length`` code points and ``min_count`` occurrences at least."""
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    texts = docs.select(key.alias("key"), F.col(f"`{text_col}`").cast("string").alias("text")).where(F.col("text").isNotNull())
    counted = texts.mapInArrow(_counts(every, min_length), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# --- the machines --------------------------------------------------------------------------------


class State(NamedTuple):
    """A state of an acceptor: its arcs by letter, and whether a word may end here."""

    arcs: dict[str, int]
    final: bool


class Machines:
    """Minimal acceptors that share their states: equal languages are one state, also across acceptors."""

    def __init__(self) -> None:
        self.states: list[State] = []
        self._known: dict[tuple, int] = {}
        self._both: dict[tuple[int, int], list[str]] = {}

    def _state(self, arcs: dict[str, int], final: bool) -> int:
        key = (final, *arcs.items())
        if (found := self._known.get(key)) is None:
            found = self._known[key] = len(self.states)
            self.states.append(State(arcs, final))
        return found

    def acceptor(self, words: list[str]) -> int:
        """Initial state of the minimal acceptor of ``words``, sorted and different."""
        # arcs of the states along the last word, from the initial one; those left behind are final and get their number
        path: list[tuple[str, dict[str, int], bool]] = [("", {}, False)]
        for word in words:
            same = 0
            while same < len(word) and same + 1 < len(path) and path[same + 1][0] == word[same]:
                same += 1
            self._close(path, same + 1)
            for letter in word[same:]:
                path.append((letter, {}, False))
            letter, arcs, _ = path[-1]
            path[-1] = (letter, arcs, True)
        self._close(path, 1)
        _, arcs, final = path[0]
        return self._state(arcs, final)

    def _close(self, path: list[tuple[str, dict[str, int], bool]], keep: int) -> None:
        while len(path) > keep:
            letter, arcs, final = path.pop()
            path[-1][1][letter] = self._state(arcs, final)

    def _straight(self, a: int, b: int) -> tuple[str, tuple[int, int]]:
        """Letters up to the next pair of states where both may end or their common letters are not just one."""
        read = []
        while True:
            left, right = self.states[a], self.states[b]
            if left.final and right.final:
                break
            letters = [c for c in left.arcs if c in right.arcs]
            if len(letters) != 1:
                break
            read += letters
            a, b = left.arcs[letters[0]], right.arcs[letters[0]]
        return "".join(read), (min(a, b), max(a, b))

    def common(self, q: int, r: int) -> list[str]:
        """Words that both states accept."""
        read, key = self._straight(q, r)
        # depth first without recursion, as words may be long: a pair is done after the pairs that it leads to
        todo = [key] if key not in self._both else []
        while todo:
            a, b = todo[-1]
            left, right = self.states[a], self.states[b]
            nexts = [(c, *self._straight(x, right.arcs[c])) for c, x in left.arcs.items() if c in right.arcs]
            if missing := [pair for _, _, pair in nexts if pair not in self._both]:
                todo += missing
                continue
            self._both[a, b] = ([""] if left.final and right.final else []) + [c + more + w for c, more, pair in nexts for w in self._both[pair]]
            todo.pop()
        return [read + w for w in self._both[key]]

    def replaced(self, q: int) -> Iterator[tuple[str, str]]:
        """Pairs of remainders from ``q`` that differ in their first letter alone."""
        arcs = list(self.states[q].arcs.items())
        for place, (c, x) in enumerate(arcs):
            for d, y in arcs[place + 1 :]:
                for rest in self.common(x, y):
                    yield c + rest, d + rest

    def inserted(self, q: int, r: int) -> Iterator[tuple[str, str]]:
        """Pairs (remainder from ``q``, the same with one more letter in front from ``r``); of equal letters the last counts as the new one."""
        left = self.states[q]
        for d, y in self.states[r].arcs.items():
            right = self.states[y]
            if left.final and right.final:
                yield "", d
            for c, x in left.arcs.items():
                if c != d and c in right.arcs:
                    for rest in self.common(x, right.arcs[c]):
                        yield c + rest, d + c + rest

    def one_edit(self, q: int, r: int | None = None) -> Iterator[tuple[str, str]]:
        """Accepted pairs of the composition: one replacement between words of ``q``, or one insertion from words of ``q`` to words of ``r``.

        Before the edit both tapes read the same letters, so the composition walks
        ``q`` (and ``r``) along one path; after it they must accept the same rest.
        """
        todo = [("", q, r)]
        while todo:
            read, a, b = todo.pop()
            for u, v in self.replaced(a) if b is None else self.inserted(a, b):
                yield read + u, read + v
            for c, x in self.states[a].arcs.items():
                if b is None:
                    todo.append((read + c, x, None))
                elif (y := self.states[b].arcs.get(c)) is not None:
                    todo.append((read + c, x, y))


def shared_beginning(a: str, b: str) -> int:
    at = 0
    while at < len(a) and at < len(b) and a[at] == b[at]:
        at += 1
    return at


def near_pairs(kind: int, size: int, at: int, words: list[str]) -> Iterator[tuple[str, str]]:
    """Pairs of near words that the part (kind, size, at) of the machine lists; ``size`` is the length of the shorter word.

    The words are those that reach its initial state, of ``size`` and ``size + 1`` code points.
    """
    if len(words) < 2:
        return
    back = kind == ENDING
    skip = {BEGINNING: at, ENDING: size - at}.get(kind, 0)
    read = [word[::-1] if back else word for word in words]
    start, rests = read[0][:skip], sorted({word[skip:] for word in read})
    short, long = ([rest for rest in rests if len(rest) == size - skip + more] for more in (0, 1))
    if not short:
        return
    machines = Machines()
    q = machines.acceptor(short)
    found = []
    if kind != INSERTED and len(short) > 1:
        found.append(machines.one_edit(q))
    if kind != REPLACED and long:
        found.append(machines.one_edit(q, machines.acceptor(long)))
    for pairs in found:
        for a, b in pairs:
            u, v = start + a, start + b
            if back:
                u, v = u[::-1], v[::-1]
            same = shared_beginning(u, v)
            if kind == BEGINNING or (kind == ENDING and same < at) or (kind in (REPLACED, INSERTED) and same == at):
                yield u, v


# --- parts of the machine over the vocabulary --------------------------------------------------------


PART = "word string, n bigint, kind int, size int, at int, start string"


def initial_states(vocabulary: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """Each word at its up to four initial states: as the shorter and as the longer word, by beginning and by ending."""
    length = F.length("word")

    def states(size: Column) -> list[Column]:
        half = F.floor(size / 2).cast("int")
        ends = ((BEGINNING, F.substring("word", F.lit(1), half)), (ENDING, F.substring("word", length - (size - half) + 1, size - half)))
        return [F.when(size >= min_length, F.struct(F.lit(kind).alias("kind"), size.alias("size"), half.alias("at"), text.alias("start"))) for kind, text in ends]

    spread = vocabulary.select("word", "n", F.explode(F.array(*states(length), *states(length - 1))).alias("part")).where("part is not null")
    return spread.select("word", "n", "part.*")


def _cut_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of a crowded state: one for each place of the edit and what the word is without it."""
    for batch in batches:
        rows: list[tuple] = []
        for word, n, kind, size, at in zip(*(batch.column(c).to_pylist() for c in ("word", "n", "kind", "size", "at"))):
            longer = len(word) > size
            for place in range(at, len(word)) if kind == BEGINNING else range(at):
                rest = word[:place] + word[place + 1 :]
                if not longer:
                    rows.append((word, n, REPLACED, size, place, rest))
                elif rest[place : place + 1] != word[place]:
                    rows.append((word, n, INSERTED, size, place, rest))
            if not longer:
                # the shorter word meets every longer one that is this word without its letter at a place
                rows += [(word, n, INSERTED, size, place, word) for place in (range(at, size + 1) if kind == BEGINNING else range(at))]
            if len(rows) >= BATCH_ROWS:
                yield _parts(rows)
                rows = []
        yield _parts(rows)


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    fields = [("word", pa.string()), ("n", pa.int64()), ("kind", pa.int32()), ("size", pa.int32()), ("at", pa.int32()), ("start", pa.string())]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[name for name, _ in fields])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both directions of every near pair; rows come sorted by part, of which one at a time is held."""
    part: tuple | None = None
    words: dict[str, int] = {}
    rows: list[tuple[str, str, int]] = []

    def close() -> None:
        if part is not None and len(words) > 1:
            for a, b in near_pairs(*part[:3], list(words)):
                rows.append((a, b, words[b]))
                rows.append((b, a, words[a]))

    def handed() -> pa.RecordBatch:
        word, near, n = zip(*rows) if rows else ((), (), ())
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(near, pa.string()), pa.array(n, pa.int64())], names=["word", "near", "near_n"])

    for batch in batches:
        for word, n, *here in zip(*(batch.column(c).to_pylist() for c in ("word", "n", "kind", "size", "at", "start"))):
            if (key := tuple(here)) != part:
                close()
                part, words = key, {}
                if len(rows) >= BATCH_ROWS:
                    yield handed()
            words[word] = n
    close()
    yield handed()


def list_near(vocabulary: DataFrame, max_words: int = MAX_WORDS, min_length: int = MIN_LENGTH) -> DataFrame:
    """(word, near, near_n): every word with each near word, from the composed machine, part by part.

    ``vocabulary`` (word, n) has each word once and is read twice, so it should be stored.
    """
    spread = initial_states(vocabulary, min_length)
    part = ["kind", "size", "at", "start"]
    crowded = stage(spread.groupBy(*part).agg(F.count(F.lit(1)).alias("words")).where(F.col("words") > max_words).drop("words"), "crowded-states")
    if not crowded.isEmpty():
        calm = spread.join(crowded, part, "left_anti")
        cut = spread.join(crowded, part).select("word", "n", *part).mapInArrow(_cut_again, PART)
        spread = calm.select("word", "n", *part).unionByName(cut)
    n = partitions(vocabulary.sparkSession)
    dealt = spread.repartition(n, *part).sortWithinPartitions(*part)
    return dealt.mapInArrow(_listed, "word string, near string, near_n bigint")


# --- forms and roots ------------------------------------------------------------------------------------


def follow(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form), one row for each word that has a form.

    A form occurs at least twice as often as its word, so chains are no longer than the number of
    bits of a count, and doubling the step each round ends them in a handful of rounds.
    """
    steps = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stage(steps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        steps = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return steps


def group_spellings(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    every: int | None = THIN,
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    max_words: int = MAX_WORDS,
) -> DataFrame:
    """Every word of the texts with its more frequent spelling.

    One row a word: ``word``, ``n`` (occurrences), ``n_near`` (words one edit
    away), ``form`` (of these the most frequent one, ties to the smallest, if it occurs at
    least twice as often), ``form_n`` and ``root`` (the last of the forms one after the
    other).  A null or empty text has no words, a null id counts as an empty key; rows that repeat are
    counted as often as they stand; further columns are ignored; a table without words gives no rows.
    """
    spark = prepare(docs.sparkSession)
    vocabulary = stage(count_words(docs, id_col, text_col, every, min_length, min_count), "vocabulary")
    near = list_near(vocabulary, max_words, min_length)
    best = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near").alias("word"))).alias("best")
    ranked = stage(near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best), "near-words")
    joined = vocabulary.join(ranked, "word", "left")
    fit = -F.col("best.order") >= 2 * F.col("n")
    grouped = stage(
        joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(fit, F.col("best.word")).alias("form"), F.when(fit, -F.col("best.order")).alias("form_n")),
        "spellings",
    )
    roots = follow(grouped.where("form is not null"))
    return grouped.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
