"""Language identification in two steps: the family first, then the language within it.

Families are groups of languages with similar letter n-grams, found from the
labelled examples.  Families, and the languages inside one, are told apart by
one-versus-one linear support vector machines over hashed letter n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zealmark.llm.common import prepare

DIMS = 1 << 13
MAX_EXAMPLES = 1200  # labelled texts that the machines are fitted on, shared evenly by the languages
LEAST_EXAMPLES = 20  # per language, however many languages there are
STEPS, RIDGE = 60, 1e-4
SLICE = 1 << 20  # code points that are looked at together
UNKNOWN = "und"
SEED = 7

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point -> itself for letters, 0 for all others."""
    if not _LETTERS:
        table = np.arange(0x110000, dtype=np.uint32)
        table[[not chr(i).isalpha() for i in range(0x110000)]] = 0
        _LETTERS.append(table)
    return _LETTERS[0]


def gram_counts(text: str) -> np.ndarray | None:
    """Hashed counts of runs of one to three letters (a word's edges count as one more letter); None if there is no letter."""
    counts, any_letter = np.zeros(DIMS, np.int64), False
    for at in range(0, len(text), SLICE):
        piece = text[max(0, at - 2) : at + SLICE].lower() + " "
        c = _letters()[np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)]
        any_letter |= bool(c.any())
        c = np.concatenate([np.zeros(2, np.uint32), c])
        last, middle, first = c[2:], c[1:-1], c[:-2]
        seen = (last | middle) > 0  # not two non-letters in a row
        a, b, d = last[seen], middle[seen], first[seen]
        h1 = a * np.uint32(0x9E3779B1)
        h2 = (h1 ^ (h1 >> np.uint32(15))) + b * np.uint32(0x85EBCA77)
        h3 = (h2 ^ (h2 >> np.uint32(13))) * np.uint32(0xC2B2AE3D) + d * np.uint32(0x27D4EB2F)
        for h in (h1, h2 * np.uint32(0x165667B1), h3 * np.uint32(0x9E3779B1)):
            counts += np.bincount(h >> np.uint32(19), minlength=DIMS)
    return counts if any_letter else None


def unit(counts: np.ndarray) -> np.ndarray:
    """Square roots of the frequencies: a vector of length one."""
    return np.sqrt(counts / counts.sum()).astype(np.float32)


class Machines(NamedTuple):
    """One-versus-one machines among ``names``: pairs of places, weights (a column per pair), biases."""

    names: tuple
    pairs: tuple[tuple[int, int], ...]
    weights: np.ndarray
    bias: np.ndarray

    def choose(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the winner for each row (most duels won, then the larger sum of margins) and its smallest margin."""
        n = len(self.names)
        if n == 1:
            return np.zeros(len(x), int), np.full(len(x), np.inf)
        margins = x @ self.weights + self.bias
        wins, sums = np.zeros((len(x), n)), np.zeros((len(x), n))
        least = np.full((len(x), n), np.inf)
        for k, (i, j) in enumerate(self.pairs):
            m = margins[:, k]
            wins[:, i] += m >= 0
            wins[:, j] += m < 0
            sums[:, i] += m
            sums[:, j] -= m
            least[:, i] = np.minimum(least[:, i], m)
            least[:, j] = np.minimum(least[:, j], -m)
        best = np.lexsort((-sums, -wins), axis=1)[:, 0] if n > 2 else (sums[:, 1] > sums[:, 0]).astype(int)
        return best, least[np.arange(len(x)), best]


def _machine(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by accelerated gradient steps; classes weigh the same. y is 1 or -1."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = ahead = np.zeros(x.shape[1] + 1, np.float32)  # the last place is the bias
    rate, momentum = 1 / (2 * 2 + RIDGE), 1.0
    for _ in range(STEPS):
        pull = share * y * np.maximum(0, 1 - y * (x @ ahead[:-1] + ahead[-1]))
        new = ahead - rate * (RIDGE * ahead - 2 * np.append(pull @ x, pull.sum()))
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, w, momentum = new + (momentum - 1) / following * (new - w), new, following
    return w[:-1], float(w[-1])


def _duels(names: list, x: np.ndarray, labels: np.ndarray) -> Machines:
    pairs = tuple(combinations(range(len(names)), 2))
    weights, bias = np.zeros((DIMS, len(pairs)), np.float32), np.zeros(len(pairs), np.float32)
    for k, (i, j) in enumerate(pairs):
        rows = (labels == i) | (labels == j)
        weights[:, k], bias[k] = _machine(x[rows], np.where(labels[rows] == i, 1, -1).astype(np.float32))
    return Machines(tuple(names), pairs, weights, bias)


def families_of(names: list[str], centres: np.ndarray) -> list[list[str]]:
    """Languages joined by the likeness of their mean n-grams (average linkage) until about sqrt(n) families are left."""
    groups = [[i] for i in range(len(names))]
    like = centres @ centres.T
    while len(groups) > max(1, round(len(names) ** 0.5)):
        score = lambda pair: np.mean([like[i, j] for i in groups[pair[0]] for j in groups[pair[1]]])
        a, b = max(combinations(range(len(groups)), 2), key=score)
        groups[a] += groups.pop(b)
    return sorted(sorted(names[i] for i in group) for group in groups)


class Model(NamedTuple):
    family: Machines  # its names are tuples of languages
    inside: tuple[Machines, ...]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        chosen, margin = self.family.choose(x)
        names = np.empty(len(x), object)
        for k, machines in enumerate(self.inside):
            rows = np.flatnonzero(chosen == k)
            if len(rows):
                best, least = machines.choose(x[rows])
                names[rows] = [machines.names[i] for i in best]
                margin[rows] = np.minimum(margin[rows], least)
        with np.errstate(over="ignore"):
            return names.tolist(), 1 / (1 + np.exp(-3 * margin))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, places, values = [], [], []
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if (counts := gram_counts(text)) is not None:
                x = unit(counts)
                langs.append(lang)
                places.append(np.flatnonzero(x).astype("<u2").tobytes())
                values.append(x[x > 0].astype("<f4").tobytes())
        yield pa.RecordBatch.from_pydict({"lang": langs, "places": pa.array(places, pa.binary()), "values": pa.array(values, pa.binary())})


def learn_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_examples: int = MAX_EXAMPLES) -> Model | None:
    """Machines fitted on at most about ``max_examples`` labelled whole texts, the first of each language by a hash of the id.

    Rows without text or language are left out; None if no language is left.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where("text is not null and lang is not null").withColumn("draw", F.pmod(F.xxhash64(F.lit(SEED), "id", "text"), F.lit(1 << 30)))
    sizes = {row.lang: row.n for row in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    each = max(LEAST_EXAMPLES, max_examples // len(sizes))
    # first a threshold on the draw, so that the ranking sees a bounded number of rows
    below = F.lit(False)
    for lang, n in sorted(sizes.items()):
        below = below | ((F.col("lang") == lang) & (F.col("draw") < int(min(1.0, 2 * each / n) * (1 << 30))))
    ranked = rows.where(below).withColumn("place", F.expr("row_number() over (partition by lang order by draw, id, text)")).where(F.col("place") <= each)
    found = ranked.select("lang", "text").mapInArrow(_featured, "lang string, places binary, values binary").collect()
    found = sorted((row.lang, bytes(row.places), bytes(row.values)) for row in found)
    names = sorted({row[0] for row in found})
    if not names:
        return None
    x = np.zeros((len(found), DIMS), np.float32)
    for k, (_, places, values) in enumerate(found):
        x[k, np.frombuffer(places, "<u2")] = np.frombuffer(values, "<f4")
    lang = np.array([names.index(row[0]) for row in found])
    centres = np.stack([x[lang == i].mean(axis=0) for i in range(len(names))])
    families = families_of(names, centres / np.linalg.norm(centres, axis=1, keepdims=True))
    of = np.array([next(k for k, family in enumerate(families) if name in family) for name in names])
    inside = []
    for family in families:
        mine = np.isin(lang, [names.index(name) for name in family])
        inside.append(_duels(family, x[mine], np.array([family.index(names[i]) for i in lang[mine]])))
    return Model(_duels([tuple(f) for f in families], x, of[lang]), tuple(inside))


OUT = "doc_id bigint, lang_pred string, score double"


def identify_language(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every whole text; ``und`` with score 0 if the text is null or has no letter, or nothing was learned."""
    prepare(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # a few columns of DIMS numbers per pair of languages

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shipped.value
        for batch in batches:
            counted = [gram_counts(text) if text else None for text in batch.column("text").to_pylist()]
            rows = [k for k, c in enumerate(counted) if c is not None and held is not None]
            names, scores = [UNKNOWN] * len(counted), np.zeros(len(counted))
            for at in range(0, len(rows), 256):
                part = rows[at : at + 256]
                found, score = held.predict(np.stack([unit(counted[k]) for k in part]))
                scores[part] = score
                for k, name in zip(part, found, strict=True):
                    names[k] = name
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang_pred": names, "score": scores})

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(identify, OUT)
