"""Document fingerprints by consistent weighted sampling.

A text is a set of words weighted by their counts.  For each of its samples, a
word draws (from its own hash, so alike in every document) two gamma numbers
r, c and a uniform b; with weight w, t = floor(ln w / r + b) and the word with the least
ln c - r (t - b + 1) is the sample, together with its t.  Two texts agree in a sample with the
probability of their generalised Jaccard likeness, the sum of least over the sum of
greatest weights.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zealmark.llm.common import narrowed, partitions, prepare, words_of
from zealmark.session import stage

SAMPLES = 64
CACHED_WORDS = 120_000  # words whose draws a worker keeps: 12 bytes per sample each; when full, the less used half goes
PIECE = 4096  # words of a text that are compared at once
EMPTY = 0xFFFF  # all samples of a text without words; no other sample has this value
SEED = 0x5EED

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _uniforms(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers in (0, 1) from each hash."""
    scale = np.float32(2.0**-24)
    high, low = (x >> np.uint64(40)).astype(np.float32), ((x >> np.uint64(8)) & np.uint64(0xFFFFFF)).astype(np.float32)
    half = np.float32(0.5)
    return np.minimum((high + half) * scale, np.float32(1 - 2.0**-24)), np.minimum((low + half) * scale, np.float32(1 - 2.0**-24))


class Sampler:
    """Draws of words, kept between texts, and the signatures made of them."""

    _held: dict[int, Sampler] = {}  # one per Python worker

    def __init__(self, samples: int = SAMPLES) -> None:
        self.samples, self.place = samples, {}
        self.hash = np.empty(CACHED_WORDS, np.uint64)
        self.r, self.b, self.base = (np.empty((CACHED_WORDS, samples), np.float32) for _ in range(3))
        self.uses = np.zeros(CACHED_WORDS, np.int64)
        self.lane = np.arange(3 * samples, dtype=np.uint64) * _STEP + np.uint64(SEED)

    @staticmethod
    def of(samples: int) -> Sampler:
        if samples not in Sampler._held:
            Sampler._held[samples] = Sampler(samples)
        return Sampler._held[samples]

    def _make_room(self) -> None:
        """Keep the draws of the most used half; what a draw is does not depend on it."""
        kept = np.sort(np.argsort(-self.uses, kind="stable")[: CACHED_WORDS // 2])
        kept = kept[kept < len(self.place)]
        words = list(self.place)
        self.place = {words[row]: at for at, row in enumerate(kept.tolist())}
        for held in (self.hash, self.r, self.b, self.base):
            held[: len(kept)] = held[kept]
        self.uses[: len(kept)] = self.uses[kept] // 2
        self.uses[len(kept) :] = 0

    def _places(self, words: list[bytes]) -> np.ndarray:
        new = [word for word in words if word not in self.place]
        if len(self.place) + len(new) > CACHED_WORDS:
            self._make_room()
            new = [word for word in words if word not in self.place]
        place = self.place
        if new:
            at = len(place)
            hashes = np.array([xxhash.xxh3_64_intdigest(word) for word in new], np.uint64)
            x = _mixed(_mixed(hashes)[:, None] + self.lane)
            k = self.samples
            u1, u2 = _uniforms(x[:, :k])
            u3, u4 = _uniforms(x[:, k : 2 * k])
            b, _ = _uniforms(x[:, 2 * k :])
            r, c = -np.log(u1 * u2), -np.log(u3 * u4)
            rows = slice(at, at + len(new))
            self.hash[rows], self.r[rows], self.b[rows], self.base[rows] = hashes, r, b, np.log(c) - r * (1 - b)
            place.update(zip(new, range(at, at + len(new)), strict=True))
        rows = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        self.uses[rows] += 1
        return rows

    def signature(self, text: bytes) -> np.ndarray:
        """16-bit samples of a text; a text without words has EMPTY throughout."""
        counts = Counter(words_of(text))
        if not counts:
            return np.full(self.samples, EMPTY, np.uint16)
        words, weights = sorted(counts), None
        weights = np.array([counts[word] for word in words], np.float32)
        least = np.full(self.samples, np.inf, np.float32)
        hashes, steps = np.zeros(self.samples, np.uint64), np.zeros(self.samples, np.float32)
        lanes = np.arange(self.samples)
        for at in range(0, len(words), PIECE):
            place, w = self._places(words[at : at + PIECE]), weights[at : at + PIECE]
            value = self.base[place]
            more = np.flatnonzero(w > 1)
            t = None
            if len(more):
                r = self.r[place[more]]
                t = np.floor(np.log(w[more])[:, None] / r + self.b[place[more]])
                value[more] -= r * t
            first = value.argmin(axis=0)
            found = value[first, lanes]
            step = np.zeros(self.samples, np.float32)
            if t is not None:
                row = np.full(len(place), -1)
                row[more] = np.arange(len(more))
                has = row[first] >= 0
                step[has] = t[row[first][has], lanes[has]]
            better = found < least
            least = np.where(better, found, least)
            hashes = np.where(better, self.hash[place[first]], hashes)
            steps = np.where(better, step, steps)
        mixed = _mixed(hashes + steps.astype(np.int64).view(np.uint64) * _STEP + lanes.astype(np.uint64))
        return (mixed % np.uint64(EMPTY)).astype(np.uint16)


def as_text(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples: the estimate of the generalised Jaccard likeness."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by the first as many code points (or all) of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_EDGES = f"{OUT}, part bigint, edge string, edge_id bigint, edge_text string"


def _row(sampler: Sampler, doc_id: int | None, text: str, own: np.ndarray, following: str, next_own: np.ndarray) -> dict:
    changed = edited(text, following)
    other = sampler.signature(changed.encode())
    return {
        "doc_id": doc_id,
        "n_chars": len(text),
        "edited_sha256": hashlib.sha256(changed.encode()).hexdigest(),
        "fingerprint": as_text(own),
        "edited_fingerprint": as_text(other),
        "near_edited": likeness(own, other),
        "near_next": likeness(own, next_own),
    }


def _batch(rows: list[dict], fields: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in fields.split(", "))])
    return pa.RecordBatch.from_pylist(rows, schema)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every whole text (null: empty) and of its edited form, by descending id (null last, equal ids by text).

    The text that follows a document decides its edited form.  Rows are laid
    out by ranges of the id and streamed with one row of look-ahead; the last
    row of a range and the first of the next, two per partition, meet in a small join afterwards.
    The last document is followed by the first; a table of one row is followed by itself.
    """
    spark = prepare(docs.sparkSession)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, part = Sampler.of(samples), TaskContext.get().partitionId()
        last, rows = None, []
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = sampler.signature(text.encode())
                if last is None:
                    rows.append({"part": part, "edge": "first", "edge_id": doc_id, "edge_text": text})
                else:
                    rows.append(_row(sampler, *last, text, own))
                last = (doc_id, text, own)
            if rows:
                yield _batch(rows, _EDGES)
                rows = []
        if last is not None:
            yield _batch([{"part": part, "edge": "last", "edge_id": last[0], "edge_text": last[1]}], _EDGES)

    ordered = narrowed(docs, id_col, text_col).repartitionByRange(partitions(spark), F.col("doc_id").desc_nulls_last())
    ordered = ordered.sortWithinPartitions(F.col("doc_id").desc_nulls_last(), "text")
    rows = stage(ordered.mapInArrow(stream, _EDGES), "fingerprints")

    edges = rows.where("edge is not null").select("part", "edge", "edge_id", "edge_text")
    parts = sorted(row.part for row in edges.where("edge = 'first'").select("part").collect())  # one per partition
    following = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part bigint, next_part bigint")
    firsts = edges.where("edge = 'first'").select(F.col("part").alias("next_part"), F.col("edge_text").alias("next_text"))
    lasts = edges.where("edge = 'last'").join(following, "part").join(firsts, "next_part").select("edge_id", "edge_text", "next_text")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler.of(samples)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                own, other = sampler.signature(row["edge_text"].encode()), sampler.signature(row["next_text"].encode())
                out.append(_row(sampler, row["edge_id"], row["edge_text"], own, row["next_text"], other))
            yield _batch(out, OUT)

    names = [field.split()[0] for field in OUT.split(", ")]
    return rows.where("edge is null").select(*names).unionByName(lasts.mapInArrow(finish, OUT))
