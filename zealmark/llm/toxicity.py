"""Toxicity by the nearest labelled examples under TF-IDF cosine.

A bounded sample of labelled texts is indexed: for each term its postings by example,
and for each block of examples the greatest weight of the term in it.  A text's
neighbours are found exactly: the block maxima bound what any example of a block can
reach, the blocks of the highest bounds give the cosines to beat, and of the others only
those are read whose bound reaches them.  Neighbours vote with weights that grow as
their distance falls, and the votes become probabilities by a monotone fit on labelled
texts outside the index.

Terms are all whole words of the examples and their beginnings.  The cosine is not the plain one of
TF-IDF: a term's weight is its TF-IDF times (1 + chi-squared)**0.7, which says how far
its presence goes with the label on the examples.  No term is left out, so rare words count as well.

Texts are scored in batches.  Frequent terms, which fill their blocks, are stored as
dense rows and met by one matrix product for each block; the others are short lists.
The sums of a batch are rounded, so they only choose candidates; the cosines that
count are added up term by term for each candidate, whatever the batch.

The index is built by one task and read by the others from a file in the shared
folder; both hold no more than the sample gives.  The driver holds the calibration curve alone.
"""

from __future__ import annotations

import gzip
import pickle
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zealmark.llm.common import give_back_memory, opened, prepare
from zealmark.session import scratch_path, stage

PER_CLASS = 3000  # indexed examples of each label at most
CALIBRATION = 4000  # further labelled texts that the probabilities are fitted on
TELLING = 0.7  # power of chi-squared in a term's weight
NEIGHBOURS = 15
BLOCK = 32
EVIDENCE = 3
# Terms that are stored as dense rows: the most frequent ones, in one of SPARSE examples at least
FREQUENT, SPARSE = 1500, 24
TEXTS_AT_ONCE = 128
BATCH_TEXTS = 8 * TEXTS_AT_ONCE  # of one Arrow batch: the index leaves a worker less room for texts
ROUNDING = 2e-5  # of single-precision sums of cosines
STARTS = (4, 5, 6)  # bytes of a word's beginnings that are terms
_LONGEST_FIRST = STARTS[::-1]
THRESHOLD = 0.3
SEED = 11

_SPLIT = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def tox_words(text: str) -> list[bytes]:
    return text.lower().encode().translate(_SPLIT).split()


def terms_of(word: bytes) -> list[bytes]:
    """The word itself and its beginnings, told apart by a first byte."""
    return [b"=" + word] + [b"^" + word[:n] for n in STARTS if len(word) > n]


class Names(NamedTuple):
    """Rows of terms by the words and beginnings that are terms: a word's row has the word first, then its beginnings from the shortest on."""

    words: dict[bytes, int]
    beginnings: dict[bytes, int]
    # terms of row r: those in [starts[r], starts[r + 1]); row 0 has none
    starts: np.ndarray
    terms: np.ndarray

    @staticmethod
    def of(terms: dict[bytes, int]) -> Names:
        words: dict[bytes, int] = {}
        beginnings: dict[bytes, int] = {}
        starts, flat = array("i", [0, 0]), array("i")
        for name in terms:
            if name[:1] == b"=":
                words[name[1:]] = len(starts) - 1
                found = terms_of(name[1:])
            else:
                beginnings[name[1:]] = len(starts) - 1
                found = [b"^" + name[1 : n + 1] for n in STARTS if n < len(name) - 1] + [name]
            flat.extend([terms[t] for t in found if t in terms])
            starts.append(len(flat))
        return Names(words, beginnings, np.array(starts, np.int32), np.array(flat, np.int32))

    def row(self, word: bytes) -> int:
        """Row of a word that is no term: that of its longest beginning that is one, which has the shorter ones too."""
        for n in _LONGEST_FIRST:
            if len(word) > n and (row := self.beginnings.get(word[:n])):
                return row
        return 0


class Index(NamedTuple):
    ids: list[int | None]  # by example
    labels: np.ndarray
    names: Names
    idf: np.ndarray  # times how far the term goes with the label
    # terms and weights by example: of example e those in [own_starts[e], own_starts[e + 1])
    own_starts: np.ndarray
    own_terms: np.ndarray
    own_weights: np.ndarray
    kinds: np.ndarray  # of each example the first one with the same terms and counts
    # postings of the terms that are not frequent: of term t those in [rare_starts[t], rare_starts[t + 1])
    rare_starts: np.ndarray
    rare_examples: np.ndarray
    rare_weights: np.ndarray
    # frequent terms: row of each (-1: not frequent), weights by block, row and place in the block, maxima by row and block
    row_of: np.ndarray
    dense: np.ndarray
    maxima: np.ndarray

    @property
    def terms(self) -> dict[bytes, int]:
        starts, terms = self.names.starts, self.names.terms
        own = {b"=" + word: int(terms[starts[row]]) for word, row in self.names.words.items()}
        return own | {b"^" + name: int(terms[starts[row + 1] - 1]) for name, row in self.names.beginnings.items()}

    # postings of all terms, put together anew each time: of term t those in [starts[t], starts[t + 1])
    @property
    def starts(self) -> np.ndarray:
        return np.searchsorted(np.sort(self.own_terms), np.arange(len(self.idf) + 1))

    @property
    def examples(self) -> np.ndarray:
        owner = np.repeat(np.arange(len(self.ids)), np.diff(self.own_starts))
        return owner[np.argsort(self.own_terms, kind="stable")]

    @property
    def weights(self) -> np.ndarray:
        return self.own_weights[np.argsort(self.own_terms, kind="stable")]


Bag = tuple[np.ndarray, np.ndarray]  # rising terms and their counts


def _bag(counts: dict[int, int] | Bag) -> Bag:
    if isinstance(counts, tuple):
        return counts
    terms = sorted(counts)
    return np.array(terms, np.int64), np.array([counts[t] for t in terms], np.int64)


def _weighted(counts: dict[int, int] | Bag, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms and unit weights."""
    terms, n = _bag(counts)
    w = (1 + np.log(n)) * idf[terms]
    return terms, w / np.sqrt((w * w).sum())


def telling(n0: np.ndarray, n1: np.ndarray, all0: int, all1: int) -> np.ndarray:
    """How far terms in n0 and n1 of the examples of each label go with it: 1 at least."""
    below = (n0 + n1) * (all0 + all1 - n0 - n1) * float(all0) * all1
    chi2 = np.divide((all0 + all1) * (n1 * (all0 - n0) - n0 * (all1 - n1)) ** 2, below, out=np.zeros(len(n0)), where=below > 0)
    return (1 + chi2) ** TELLING  # a term that tells nothing has 1


def build_index(examples: list[tuple[int | None, int, dict[int, int] | Bag]], terms: dict[bytes, int]) -> Index:
    """Index of (id, label, counts by term) examples; those without terms can be nobody's neighbour and are left out."""
    held = [(i, label, *_bag(counts)) for i, label, counts in examples]
    held = [x for x in held if len(x[2])]
    held.sort(key=lambda x: (x[1], x[2][0], x[0] is None, x[0] or 0))  # like examples share blocks
    df = np.zeros((2, len(terms)))
    for _, label, found, _ in held:
        df[int(label), found] += 1
    n1 = sum(bool(x[1]) for x in held)
    idf = (np.log((len(held) + 1) / (df.sum(0) + 1)) + 1) * telling(df[0], df[1], len(held) - n1, n1)
    none = np.zeros(0, np.int64)
    term = np.concatenate([none, *(x[2] for x in held)])
    example = np.repeat(np.arange(len(held), dtype=np.int32), [len(x[2]) for x in held])
    weight = np.concatenate([np.zeros(0), *(_weighted((x[2], x[3]), idf)[1] for x in held)]).astype(np.float32)
    firsts: dict[bytes, int] = {}
    kinds = [firsts.setdefault(x[2].tobytes() + x[3].tobytes(), e) for e, x in enumerate(held)]
    n = np.bincount(term, minlength=len(terms))
    frequent = np.sort(np.argsort(-n, kind="stable")[:FREQUENT])
    frequent = frequent[n[frequent] >= max(2, len(held) // SPARSE)]
    row_of = np.full(len(terms), -1, np.int32)
    row_of[frequent] = np.arange(len(frequent))
    blocks = -(-len(held) // BLOCK)
    dense = np.zeros((blocks, len(frequent), BLOCK), np.float32)
    row = row_of[term]
    met = row >= 0
    dense[example[met] // BLOCK, row[met], example[met] % BLOCK] = weight[met]
    rare = np.flatnonzero(~met)
    rare = rare[np.argsort(term[rare], kind="stable")]  # within a term by example
    return Index(
        ids=[x[0] for x in held],
        labels=np.array([x[1] for x in held], float),
        names=Names.of(terms),
        idf=idf,
        own_starts=np.searchsorted(example, np.arange(len(held) + 1)),
        own_terms=term.astype(np.int32),
        own_weights=weight,
        kinds=np.array(kinds, np.int64),
        rare_starts=np.searchsorted(term[rare], np.arange(len(terms) + 1)),
        rare_examples=example[rare].astype(np.min_scalar_type(-len(held) - 1)),  # the narrowest that holds all places
        rare_weights=weight[rare],
        row_of=row_of,
        dense=dense,
        maxima=np.ascontiguousarray(dense.max(axis=2, initial=0).T),
    )


Query = tuple[np.ndarray, np.ndarray]  # terms and their weights


def _spans(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places of spans that begin at ``begin`` and are ``n`` long, one after the other."""
    ends = np.cumsum(n)
    places = np.repeat(begin - ends + n, n)
    places += np.arange(len(places))
    return places


def _partial(index: Index, queries: list[Query]) -> tuple[np.ndarray, np.ndarray]:
    """What the terms that are not frequent add to each query and example, and the queries' weights of the frequent ones."""
    blocks, rows, _ = index.dense.shape
    frequent = np.zeros((len(queries), rows), np.float32)
    owner = np.repeat(np.arange(len(queries)), [len(terms) for terms, _ in queries])
    terms, weights = (np.concatenate(parts) for parts in zip(*queries))
    row = index.row_of[terms]
    met = row >= 0
    frequent[owner[met], row[met]] = weights[met]
    width = blocks * BLOCK
    added = np.zeros((len(queries), width), np.float32)
    # one query at a time, whose postings stay in the cache
    for n, (terms, weights) in enumerate(queries):
        some = index.row_of[terms] < 0
        terms, weights = terms[some], weights[some]
        begin = index.rare_starts[terms]
        length = index.rare_starts[terms + 1] - begin
        places = _spans(begin, length)
        # no place is out of range; with "clip" numpy takes them without a check of its own
        examples, found = (column.take(places, mode="clip") for column in (index.rare_examples, index.rare_weights))
        added[n] = np.bincount(examples, found * np.repeat(weights, length), width)
    return added, frequent


def _read_blocks(index: Index, scores: np.ndarray, frequent: np.ndarray, wanted: np.ndarray) -> None:
    """Add what the frequent terms give in the wanted (query, block) pairs."""
    for block in np.flatnonzero(wanted.any(0)):
        some = np.flatnonzero(wanted[:, block])
        scores[some, block * BLOCK : (block + 1) * BLOCK] += frequent[some] @ index.dense[block]


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th highest score of each row; 0 where there are not as many."""
    return np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.zeros(len(scores), scores.dtype)


def nearest_of(index: Index, queries: list[Query], k: int = NEIGHBOURS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the ``k`` examples of the highest cosine above 0 and their cosines, exactly; equal cosines by place in the index."""
    if not queries or not len(index.ids):
        return [(np.zeros(0, np.int64), np.zeros(0)) for _ in queries]
    scores, frequent = _partial(index, queries)
    blocks = index.dense.shape[0]
    by_block = scores.reshape(len(queries), blocks, BLOCK)
    bounds = by_block.max(2) + frequent @ index.maxima
    best = min(blocks, -(-2 * k // BLOCK) + 1)
    first = np.argpartition(bounds, blocks - best, axis=1)[:, blocks - best :]
    read = np.zeros(bounds.shape, bool)
    np.put_along_axis(read, first, True, axis=1)
    _read_blocks(index, scores, frequent, read)
    # k cosines to beat, from the blocks of the highest bounds
    beaten = _kth(np.take_along_axis(by_block, first[:, :, None], axis=1).reshape(len(queries), -1), k) - ROUNDING
    more = ~read & (bounds >= beaten[:, None]) & (bounds > 0)
    _read_blocks(index, scores, frequent, more)
    read |= more
    near = by_block >= np.maximum(beaten, np.finfo(np.float32).smallest_subnormal)[:, None, None]
    near &= read[:, :, None]
    weight_of = np.zeros(len(index.idf))
    out = []
    for (terms, weights), row, chosen in zip(queries, scores, near.reshape(len(queries), -1)):
        found = np.flatnonzero(chosen)
        if len(found) > k:
            held = row[found]
            found = found[held >= np.partition(held, -k)[-k] - ROUNDING]
        # copies of one example have one cosine
        kinds, kind = np.unique(index.kinds[found], return_inverse=True)
        weight_of[terms] = weights
        spans = [slice(*span) for span in zip(index.own_starts[kinds].tolist(), index.own_starts[kinds + 1].tolist())]
        exact = np.array([weight_of[index.own_terms[span]] @ index.own_weights[span] for span in spans], float)[kind]
        weight_of[terms] = 0
        order = np.lexsort((found, -np.round(exact, 9)))[:k]
        out.append((found[order], exact[order]))
    return out


def nearest(index: Index, terms: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
    """``nearest_of`` for one query."""
    return nearest_of(index, [(terms, weights)], k)[0]


def vote(labels: np.ndarray, cosines: np.ndarray) -> float:
    """Share of the label among neighbours, each weighing cosine over distance; -1 without neighbours."""
    if not len(cosines):
        return -1.0
    weight = cosines / (1.05 - np.minimum(cosines, 1.0))
    return float((weight * labels).sum() / weight.sum())


class Calibration(NamedTuple):
    votes: np.ndarray  # rising
    rates: np.ndarray  # not falling
    none: float  # without neighbours

    def score(self, votes: np.ndarray) -> np.ndarray:
        if not len(self.votes):
            return np.full(len(votes), self.none)
        return np.where(votes < 0, self.none, np.interp(votes, self.votes, self.rates))


def calibrate(votes: np.ndarray, labels: np.ndarray) -> Calibration:
    """Monotone fit of label rates to distinct votes, pooled wherever a rate would fall (pool adjacent violators).

    A pool's rate holds from its least to its greatest vote, so a few rows of a
    rare label at the top keep their own rate however many other rows there are.
    """
    none = votes < 0
    prior = (labels.sum() + 0.5) / (len(labels) + 1)
    none_rate = (labels[none].sum() + prior) / (none.sum() + 1)
    distinct, at = np.unique(np.round(votes[~none], 9), return_inverse=True)
    pooled: list[list[float]] = []  # sum of labels, number, least and greatest vote
    for vote, y, n in zip(distinct, np.bincount(at, labels[~none], len(distinct)), np.bincount(at, minlength=len(distinct)), strict=True):
        pooled.append([y, n, vote, vote])
        while len(pooled) > 1 and pooled[-2][0] / pooled[-2][1] >= pooled[-1][0] / pooled[-1][1]:
            y, n, _, high = pooled.pop()
            pooled[-1] = [pooled[-1][0] + y, pooled[-1][1] + n, pooled[-1][2], high]
    rates = np.maximum.accumulate([(y + prior) / (n + 1) for y, n, _, _ in pooled])  # a small pool is drawn to the prior
    return Calibration(np.array([v for p in pooled for v in p[2:]]), np.repeat(rates, 2), float(none_rate))


class Learner:
    """Numbers of the words and terms of texts, all of which it takes up."""

    def __init__(self) -> None:
        self.terms: dict[bytes, int] = {}
        self._words: dict[bytes, int] = {}
        # terms of word w: those in [starts[w], starts[w + 1])
        self._flat, self._starts = array("i"), array("i", [0])

    def _row(self, word: bytes) -> int:
        if word not in self._words:
            self._words[word] = len(self._words)
            self._flat.extend([self.terms.setdefault(t, len(self.terms)) for t in terms_of(word)])
            self._starts.append(len(self._flat))
        return self._words[word]

    def counts_of(self, texts: list[str]) -> list[Bag]:
        found = [Counter(tox_words(text)) for text in texts]
        rows = [[self._row(word) for word in words] for words in found]
        return _bags(rows, found, np.array(self._starts, np.int64), np.array(self._flat, np.int64), len(self.terms))


class Scorer:
    """Counts of an index's terms in texts."""

    def __init__(self, index: Index) -> None:
        self.names, self.size = index.names, len(index.idf)

    def counts_of(self, texts: list[str]) -> list[Bag]:
        known, other = self.names.words.get, self.names.row
        found = [Counter(tox_words(text)) for text in texts]
        rows = [[known(word) or other(word) for word in words] for words in found]
        return _bags(rows, found, self.names.starts, self.names.terms, self.size)


def _bags(rows: list[list[int]], found: list[Counter[bytes]], starts: np.ndarray, flat: np.ndarray, size: int) -> list[Bag]:
    """Terms and counts of each text from the rows of its words and how often it has them."""
    sizes = [len(of_text) for of_text in rows]
    row = np.fromiter(chain.from_iterable(rows), np.int64, sum(sizes))
    often = np.fromiter(chain.from_iterable(words.values() for words in found), np.int64, len(row))
    begin = starts[row]
    n = starts[row + 1] - begin
    size = max(size, 1)
    owner = np.repeat(np.repeat(np.arange(len(rows)), sizes), n)
    keys, at = np.unique(owner * size + flat[_spans(begin, n)], return_inverse=True)
    counts = np.bincount(at, np.repeat(often, n), len(keys)).astype(np.int64)
    ends = np.searchsorted(keys, np.arange(len(rows) + 1) * size)
    return [(keys[low:high] - text * size, counts[low:high]) for text, (low, high) in enumerate(zip(ends[:-1], ends[1:]))]


class Model(NamedTuple):
    calibration: Calibration
    path: str  # of the index in the shared folder

    @property
    def index(self) -> Index:
        return _loaded(self.path)


@lru_cache(maxsize=1)
def _loaded(path: str) -> Index:
    _loaded.cache_clear()  # the index before it goes first, so that a worker never holds two
    files, place = opened(path)
    with files.open_input_stream(place) as held, gzip.GzipFile(fileobj=held) as plain:
        return pickle.load(plain)


def release() -> None:
    """Give up the index that this worker holds; the next task that needs it loads it again."""
    _loaded.cache_clear()
    give_back_memory()


def _builder(folder: str):
    """Index of the examples that one task is given, written to the shared folder; its path is all that comes back."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("id", "label", "text")))]
        rows.sort(key=lambda row: (row[0] is None, row[0] or 0))
        scorer = Learner()
        bags = []
        for at in range(0, len(rows), TEXTS_AT_ONCE):
            found = scorer.counts_of([text for _, _, text in rows[at : at + TEXTS_AT_ONCE]])
            bags += [(terms.astype(np.int32), counts.astype(np.int32)) for terms, counts in found]
        rows = [(key, label) for key, label, _ in rows]
        n = np.zeros((2, len(scorer.terms)))
        for (_, label), (found, _) in zip(rows, bags):
            n[int(label), found] += 1
        alls = np.bincount([int(label) for _, label in rows], minlength=2)
        first = telling(n[0], n[1], alls[0], alls[1])
        names = list(scorer.terms)
        order = sorted(range(len(names)), key=lambda i: (-first[i], names[i]))
        place = np.empty(len(names), np.int32)
        place[order] = np.arange(len(names), dtype=np.int32)
        for at, ((key, label), (found, counts)) in enumerate(zip(rows, bags)):
            turned = np.argsort(place[found])
            bags[at] = (key, label, (place[found][turned], counts[turned]))
        del scorer, n, first
        index = build_index(bags, {names[i]: at for at, i in enumerate(order)})
        # a name of its own: a task that is repeated leaves another file
        files, path = opened(f"{folder}-{uuid.uuid4().hex}")
        with files.open_output_stream(path) as out, gzip.GzipFile(fileobj=out, mode="wb", compresslevel=1) as packed_out:
            pickle.dump(index, packed_out, 5)
        del rows, bags, names, order, place, index
        give_back_memory()
        yield pa.RecordBatch.from_pydict({"path": [path]})

    return build


def labelled_examples(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """id, text, label, role: the bounded sample, drawn by a hash of the id; role 0 is indexed, role 1 calibrates."""
    spark = docs.sparkSession
    ids = docs.select(F.col(id_col).cast("bigint").alias("id"))
    known = labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    known = known.groupBy("id").agg(F.max("label").alias("label"))  # conflicting labels of an id: 1
    known = stage(known.join(ids, "id", "left_semi").withColumn("draw", F.xxhash64(F.lit(SEED), "id")), "tox-labels")
    # a quarter of the ids calibrates, by the labels' own proportions; the index draws from the rest, label by label
    pool = F.pmod(F.col("draw"), F.lit(4))
    indexed = [known.where((pool != 0) & (F.col("label") == label)).orderBy("draw", "id").limit(PER_CLASS) for label in (0, 1)]
    chosen = indexed[0].unionByName(indexed[1]).select("id", "label", F.lit(0).alias("role"))
    rest = known.where(pool == 0).orderBy("draw", "id").limit(CALIBRATION)
    sample = stage(chosen.unionByName(rest.select("id", "label", F.lit(1).alias("role"))), "tox-sample")
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # the sample has at most 2 * PER_CLASS + CALIBRATION rows of three numbers
    # of the texts of an id that repeats the least one, whatever the order of rows
    one = texts.join(F.broadcast(sample), "id").groupBy("id", "label", "role").agg(F.min("text").alias("text"))
    return stage(one.repartition(8, "id"), "tox-texts")


def learn_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Index and calibration from labelled rows of ``docs``.

    At most PER_CLASS texts of each label are indexed and CALIBRATION others
    calibrate; labels other than 0 and 1 are ignored.  Without labelled rows every score is 0.5.
    """
    prepare(docs.sparkSession, BATCH_TEXTS)
    rows = labelled_examples(docs, labels, id_col, text_col, label_col)
    spark = docs.sparkSession
    # one task holds the sample, as each task that scores will hold its index
    built = rows.where("role = 0").select("id", "label", "text").repartition(1).mapInArrow(_builder(scratch_path(spark, "tox-index")), "path string")
    path = built.first()["path"]

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _loaded(path)
        scorer = Scorer(held)
        for batch in batches:
            found = _votes(held, scorer, batch.column("text").to_pylist(), batch.column("id").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([v for v, _ in found], pa.float64())], names=["label", "vote"])

    calibrating = rows.where("role = 1")
    if calibrating.select("label").distinct().count() < 2:  # too few rows to set any aside
        calibrating = rows
    rest = calibrating.select("id", "label", "text").mapInArrow(voted, "label int, vote double").collect()
    return Model(calibrate(np.array([row.vote for row in rest], float), np.array([row.label for row in rest], float)), path)


def _votes(index: Index, scorer: Scorer, texts: list[str | None], own: list[int | None] | None = None) -> list[tuple[float, list]]:
    """Vote and evidence of each text; with ``own`` the example of a text's own id is no neighbour of it."""
    if own is None:
        # a text that repeats among these is scored once
        numbers: dict[str | None, int] = {}
        number = [numbers.setdefault(text, len(numbers)) for text in texts]
        if len(numbers) < len(texts):
            once = _votes(index, scorer, list(numbers))
            return [once[n] for n in number]
    out = []
    for at in range(0, len(texts), TEXTS_AT_ONCE):
        bags = scorer.counts_of([text or "" for text in texts[at : at + TEXTS_AT_ONCE]])
        queries = [_weighted(bag, index.idf) if len(bag[0]) else (np.zeros(0, np.int64), np.zeros(0)) for bag in bags]
        for n, (places, cosines) in enumerate(nearest_of(index, queries, NEIGHBOURS + (own is not None))):
            if own is not None:
                other = np.array([index.ids[p] != own[at + n] for p in places.tolist()], bool)
                places, cosines = places[other][:NEIGHBOURS], cosines[other][:NEIGHBOURS]
            out.append((vote(index.labels[places], cosines), [index.ids[p] for p in places[:EVIDENCE].tolist()]))
    return out


def _votes_of(index: Index, scorer: Scorer, texts: pa.Array) -> list[tuple[float, list]]:
    """``_votes`` of a column, of which a part at a time becomes Python strings."""
    step = 4 * TEXTS_AT_ONCE
    return [vote for at in range(0, len(texts), step) for vote in _votes(index, scorer, texts.slice(at, step).to_pylist())]


OUT = "doc_id bigint, score double, predicted int, evidence array<bigint>"


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from ``threshold`` on), evidence (ids of the nearest examples) of every whole text; null is empty."""
    prepare(docs.sparkSession, BATCH_TEXTS)
    path, calibration = model.path, model.calibration

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _loaded(path)
        scorer = Scorer(held)
        for batch in batches:
            found = _votes_of(held, scorer, batch.column("text"))
            scores = calibration.score(np.array([v for v, _ in found], float))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(scores),
                    pa.array((scores >= threshold).astype(np.int32)),
                    pa.array([ids for _, ids in found], pa.list_(pa.int64())),
                ],
                names=["doc_id", "score", "predicted", "evidence"],
            )

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, OUT)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the texts scored at ``threshold`` or more: decided row by row, so all columns and repeated rows stay whole."""
    prepare(docs.sparkSession, BATCH_TEXTS)
    path, calibration = model.path, model.calibration

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _loaded(path)
        scorer = Scorer(held)
        for batch in batches:
            votes = [v for v, _ in _votes_of(held, scorer, batch.column("text"))]
            yield batch.filter(pa.array(calibration.score(np.array(votes, float)) < threshold))
        # the worker lives on and serves the stages after this one, which need the memory
        del held, scorer
        release()

    return docs.mapInArrow(keep, docs.schema)
