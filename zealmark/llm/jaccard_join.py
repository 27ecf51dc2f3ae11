"""Near-duplicate classes by a parity-sketch join of shingle sets.

A document is its set of distinct 5-word shingles; two link when their Jaccard
likeness is at least 75/100.  Then their symmetric difference D is at most
(|A| + |B|) / 7, and the sizes differ by a third at most.

Per size band a set is cut into segments by a hash of the shingle, and each
segment keeps the XOR of its shingles' hashes: a parity sketch.  A shingle in one set only
changes one segment, so the number of segments that differ is at most D, and of any
D + 1 segments of a set one agrees.  Sets therefore meet by their first D + 1 segments that are
not empty (and some spare ones, see below).  A further parity sketch of single bits, a few
per shingle, whose Hamming distance is at most D too, rejects nearly all chance meetings; what
is left is verified on the texts.

Copies.  Equal sets are one node, so exact copies never meet each other.  Nodes
that meet in a key are not paired with each other: a few of them stand for the
key, the others are compared with those, and only nodes that are still in different components
are compared further, until none are left.  From the second round on a key's nodes are dealt over
blocks of bounded size, where sizes and folded sketches are compared as arrays, so that only those that may link
become pairs.  No link between components is lost,
as every node that has stood for a key has been compared with all of that key.

Frequent keys.  A frequent key comes from a passage that many documents share.
Sets emit spare segments, so any two that link share s keys at least, s being known from
the size.  Each set therefore drops its s - 1 most frequent keys, in one order that holds for all sets:
what two sets have dropped of their shared keys are two beginnings of the same list,
the longer of which leaves one key at least.  A set with fewer than s keys that others have
too links with nothing and drops all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zealmark.llm.common import bitmap_spot, byte_list, giving_back, in_bitmap, narrowed, packed, partitions, prepare, seen_bitmap
from zealmark.llm.components import connected
from zealmark.session import stage

SHINGLE = 5
LIKE = (75, 100)
HOT_NODES = 64
SPARE = 0.08  # spare segments per shingle
DENSITY = 1.6  # shingles per segment for the largest sets of a band
LEAST_SEGMENTS = 64
REPS_GROWTH = 64  # nodes that stand for a key: one in the first round, then so many times more each round
SHORT_WORDS = 16  # 64-bit numbers of a folded sketch, by which nodes of a key are told apart before they become pairs
BLOCK_REPS, BLOCK_NODES = 1024, 4096  # of one key, how many that stand for it and how many others meet in one block
COMPARED = 1 << 20  # numbers of sketches that are compared at once
LEAST_KEYS, NO_KEY = 16, (1 << 63) - 1  # open keys that a row of a block carries, and what fills a shorter list
PAIRS_AT_ONCE = 1 << 15
SEEN_NODES = 500_000
OUT_ROWS = 50_000

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


_PLACES = _mixed(np.arange(1, SHINGLE + 1, dtype=np.uint64) * _A) | np.uint64(1)  # odd factors of a shingle's words
SLICE = 1 << 20  # bytes of a text that are hashed at once, up to the next white space
_SPACE = re.compile(rb"[ \t-\r]")
_INSIDE = bytes(0 if c == 0x20 or 0x09 <= c <= 0x0D else 1 for c in range(256))
_FIRST_BYTES = np.array([0, *((1 << 8 * n) - 1 for n in range(1, 8)), 2**64 - 1], np.uint64)  # mask of a word's first n bytes
LONG_WORD = 1024
_TRUE = np.ones(1, bool)


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word between white space, A-Z in lower case, and where the word begins."""
    hashes, places, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(text):
        cut = _SPACE.search(text, at + SLICE)
        end = cut.start() if cut else len(text)
        piece = text[at:end].lower()
        inside = np.frombuffer(piece.translate(_INSIDE), np.int8)
        edges = np.flatnonzero(np.diff(inside, prepend=0, append=0))
        starts, lengths = edges[::2], edges[1::2] - edges[::2]
        if len(starts):
            eights = np.ndarray((len(piece) + 1,), "<u8", piece + bytes(8), strides=(1,))  # the eight bytes from each place on
            h = _mixed((eights[starts] & _FIRST_BYTES[np.minimum(lengths, 8)]) + lengths.astype(np.uint64) * _B)
            done, more = 8, np.flatnonzero(lengths > 8)
            while len(more) and done < LONG_WORD:
                rest = eights[starts[more] + done] & _FIRST_BYTES[np.minimum(lengths[more] - done, 8)]
                h[more] = _mixed(h[more] * _A + rest)
                done += 8
                more = more[lengths[more] > done]
            for k in more.tolist():
                h[k] = xxhash.xxh3_64_intdigest(piece[starts[k] : starts[k] + lengths[k]])
            hashes.append(h)
            places.append(starts + at)
        at = end
    return np.concatenate(hashes), np.concatenate(places)


def _sums(h: np.ndarray, n: int) -> np.ndarray:
    out = h[: len(h) - n + 1] * _PLACES[0] + np.uint64(n)
    for i in range(1, n):
        out += h[i : len(h) - n + 1 + i] * _PLACES[i]
    return _mixed(out)


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct 5-word shingles; fewer words are one shingle, none are an empty set.

    Texts are hashed together, about SLICE bytes at a time.
    """
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) < SLICE):
            size += len(texts[upto])
            upto += 1
        part = texts[at:upto]
        at = upto
        h, places = word_hashes(b"\n".join(part))
        ends = np.searchsorted(places, np.cumsum([len(text) + 1 for text in part])).tolist()
        sums = _sums(h, SHINGLE) if len(h) >= SHINGLE else h[:0]
        begin = 0
        for end in ends:
            if end - begin >= SHINGLE:
                out = np.sort(sums[begin : end - SHINGLE + 1])
                yield out[np.concatenate((_TRUE, out[1:] != out[:-1]))]
            else:
                yield _sums(h[begin:end], end - begin) if end > begin else h[:0]
            begin = end


def shingles(text: bytes) -> np.ndarray:
    return next(shingle_sets([text]))


def node_of(hashes: np.ndarray) -> int:
    """63-bit name of a set."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) >> 1


def bit_sketch(hashes: np.ndarray) -> list[int]:
    """Parity of the shingles that fall on each bit, as 64-bit numbers; a power of two of bits, two to four per shingle."""
    bits = max(64, 1 << (2 * len(hashes) - 1).bit_length())
    odd = np.bincount((_mixed(hashes ^ _B) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def hamming(a: str, b: str) -> Column:
    """Differing bits of two sketches; of sizes that may link one is at most twice as long, and is folded to the other's length."""

    def folded(own: str, other: str) -> Column:
        half = (F.size(own) / 2).cast("int")
        halves = F.zip_with(F.slice(own, F.lit(1), half), F.slice(own, half + 1, half), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(own) > F.size(other), halves).otherwise(F.col(own))

    return F.aggregate(F.zip_with(folded(a, b), folded(b, a), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)


def short_sketch(sketch: str) -> Column:
    """A sketch folded to SHORT_WORDS numbers at most; the Hamming distance of folded sketches is a lower bound too."""
    every = lambda i: F.filter(sketch, lambda _, k: k % SHORT_WORDS == i)
    folded = F.transform(F.sequence(F.lit(0), F.lit(SHORT_WORDS - 1)), lambda i: F.aggregate(every(i), F.lit(0).cast("bigint"), lambda x, y: x.bitwiseXOR(y)))
    return F.when(F.size(sketch) <= SHORT_WORDS, F.col(sketch)).otherwise(folded)


def most_apart(size: int) -> int:
    """Greatest symmetric difference from any set that links with one of this size."""
    return (size + size * LIKE[1] // LIKE[0]) * (LIKE[1] - LIKE[0]) // (LIKE[0] + LIKE[1])


def spare(size: int) -> int:
    return max(2, int(SPARE * size))


def bands_of(size: int) -> list[int]:
    """Bands [4^k, 4^(k+1)) hold the smaller set of a pair; a set that the largest of the band below may link with joins it there too."""
    k = (size.bit_length() - 1) // 2
    return [k, k - 1] if k and LIKE[0] * size <= LIKE[1] * 4**k else [k]


def band_keys(hashes: np.ndarray, band: int) -> tuple[np.ndarray, int]:
    """Keys by which a set is met in a band, and how many of them any partner of it is sure to share."""
    size = len(hashes)
    segments = max(LEAST_SEGMENTS, int(4 ** (band + 1) * LIKE[1] / LIKE[0] / DENSITY))
    salted = _mixed(hashes + np.uint64((band + 1) * int(_B) % 2**64))
    of = (salted % np.uint64(segments)).astype(np.int64)
    order = np.argsort(of)
    of = of[order]
    first = np.flatnonzero(np.concatenate((_TRUE, of[1:] != of[:-1])))
    parity = np.bitwise_xor.reduceat(salted[order], first)
    filled = of[first].astype(np.uint64)
    apart = most_apart(size)
    least = -(-size * LIKE[0] // LIKE[1])
    sure = min(1 + spare(least), len(filled) - apart)  # the smaller partner may end its list first, so its spare segments count
    upto = apart + 1 + spare(size)
    keys = _mixed(parity[:upto] + filled[:upto] * _B + np.uint64(band))
    if sure <= 0:  # all filled segments may differ: such sets meet by a key of their own
        keys = np.append(keys, _mixed(np.array([band], np.uint64) + _A))
        sure = 1
    return keys, sure


PROFILE = "doc_id bigint, text_key bigint, n_shingles bigint, node bigint, sketch array<bigint>"


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, nodes, sketches = [], [], []
        for hashes in shingle_sets(byte_list(batch, "text")):
            sizes.append(len(hashes))
            nodes.append(node_of(hashes) if len(hashes) else None)
            sketches.append(bit_sketch(hashes) if len(hashes) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sketches, pa.list_(pa.int64()))],
            names=["doc_id", "text_key", "n_shingles", "node", "sketch"],
        )


# band and sure: how many keys of the node's band its partners share at least, packed as sure * 32 + band
KEYS = "key bigint, node bigint, info int"


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()  # copies within a task are told apart here, so a large group of copies is small before the shuffle
    keys, nodes, infos, rows = [], [], [], 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(infos))], names=["key", "node", "info"]
        )

    for batch in batches:
        for hashes in shingle_sets(byte_list(batch, "text")):
            if not len(hashes) or (node := node_of(hashes)) in seen:
                continue
            if len(seen) >= SEEN_NODES:
                seen.clear()
            seen.add(node)
            for band in bands_of(len(hashes)):
                found, sure = band_keys(hashes, band)
                keys.append(found)
                nodes.append(np.full(len(found), node, np.int64))
                infos.append(np.full(len(found), min(sure, 1 << 25) * 32 + band, np.int32))
                rows += len(found)
            if rows >= OUT_ROWS:
                yield flush()
                keys, nodes, infos, rows = [], [], [], 0
    if rows:
        yield flush()


SHARED = "key bigint, node bigint, info int, n_nodes int"


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and node, those whose key has several nodes, and how many; null if more than HOT_NODES."""
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]  # the last key's rows so far, HOT_NODES + 1 at most
    hot_key: int | None = None  # a key that is known to be hot and whose rows so far are out

    def done(key: np.ndarray, node: np.ndarray, info: np.ndarray) -> pa.RecordBatch | None:
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        length = np.diff(np.append(first, len(key)))
        of = np.repeat(length, length)
        keep = (of > 1) | (key == hot_key)
        if not keep.any():
            return None
        hot = (of > HOT_NODES) | (key == hot_key)
        counts = pa.array(of[keep].astype(np.int32), mask=hot[keep])
        return pa.RecordBatch.from_arrays([*(pa.array(x[keep]) for x in (key, node, info)), counts], names=["key", "node", "info", "n_nodes"])

    for batch in batches:
        new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "node", "info")]
        key, node, info = (np.concatenate(pair) for pair in zip(held, new, strict=True))
        if not len(key):
            continue
        distinct = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
        key, node, info = key[distinct], node[distinct], info[distinct]
        begin = int(np.searchsorted(key, key[-1]))  # the last key's rows wait for the next batch
        if begin and (out := done(key[:begin], node[:begin], info[:begin])) is not None:
            yield out
        if begin:
            hot_key = hot_key if hot_key == key[-1] else None
        key, node, info = key[begin:], node[begin:], info[begin:]
        if len(key) > HOT_NODES or hot_key == key[-1]:
            hot_key = int(key[-1])
            if len(key) > 1:  # all but the last row, which tells a repeated node
                out = done(key[:-1], node[:-1], info[:-1])
                if out is not None:
                    yield out
            key, node, info = key[-1:], node[-1:], info[-1:]
        held = [key, node, info]
    if len(held[0]) and (out := done(*held)) is not None:
        yield out


def meeting_keys(rows: DataFrame) -> DataFrame:
    """(key, node) of all keys by which nodes have to be compared."""
    spark = rows.sparkSession
    laid = rows.select("text").mapInArrow(giving_back(_keys), KEYS).repartition(partitions(spark), "key").sortWithinPartitions("key", "node")
    shared = stage(laid.mapInArrow(giving_back(_shared), SHARED), "shared-keys")
    hot = shared.where("n_nodes is null").drop("n_nodes")
    counted = hot.join(hot.groupBy("key").agg(F.count("*").alias("n_nodes")), "key")
    weighed = shared.where("n_nodes is not null").unionByName(counted)
    # a window holds the keys of one set, so no more rows than its text has shingles
    placed = weighed.withColumn("place", F.expr("row_number() over (partition by node, info order by n_nodes desc, key)"))
    return stage(placed.where(F.col("place") >= F.floor(F.col("info") / 32)).select("key", "node"), "meeting-keys")


def _may_link(u: dict[str, np.ndarray], v: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the nodes ``u`` and ``v`` that may link, by size and sketch, and are not in one component; sketches are as long as a row is wide."""
    width = min(u["sketch"].shape[1], v["sketch"].shape[1])
    a, b = (np.bitwise_xor.reduce(x["sketch"].reshape(len(x["sketch"]), -1, width), axis=1) for x in (u, v))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    step = max(1, COMPARED // (len(b) * width))
    for at in range(0, len(a), step):
        size_u, size_v = u["size"][at : at + step, None], v["size"][None, :]
        apart = np.bitwise_count(a[at : at + step, None, :] ^ b[None, :, :]).sum(axis=2, dtype=np.int64)
        near = apart * (LIKE[0] + LIKE[1]) <= (size_u + size_v) * (LIKE[1] - LIKE[0])
        near &= np.minimum(size_u, size_v) * LIKE[1] >= np.maximum(size_u, size_v) * LIKE[0]
        near &= u["root"][at : at + step, None] != v["root"][None, :]
        left, right = np.nonzero(near)
        found.append((left + at, right))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _met_elsewhere(key: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which pairs of rows of least keys (rising, filled up with NO_KEY) share a key, the least of which is not this one."""
    out = np.zeros(len(u), bool)
    for at in range(0, len(u), PAIRS_AT_ONCE):
        a, b = u[at : at + PAIRS_AT_ONCE], v[at : at + PAIRS_AT_ONCE]
        shared = ((a[:, :, None] == b[:, None, :]) & (a != NO_KEY)[:, :, None]).any(axis=2)
        least = np.where(shared, a, NO_KEY).min(axis=1)
        out[at : at + PAIRS_AT_ONCE] = shared.any(axis=1) & (least != key)
    return out


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (u, v) that may link, of rows sorted by block with those that stand for the key, BLOCK_REPS at most, first.

    Two nodes may share many open keys.  Each row carries the least open keys of
    its node; a pair that shares some of these is left to the least of them.
    No pair is lost: keys only close and lists only move up, so that key remains the least they
    share until one of the two stands for it, unless their components have become one.
    """
    block: tuple[int, ...] | None = None
    standing: list[tuple[int, dict[str, np.ndarray]]] = []  # of the block under way, by length of the sketch
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "part", "chunk", "other", "node", "root", "size")}
        lists = batch.column("sketch")
        least = batch.column("keys").flatten().to_numpy(zero_copy_only=False).reshape(-1, LEAST_KEYS)
        words, ends = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        lengths = np.diff(ends, prepend=0)
        same = [columns[c][1:] == columns[c][:-1] for c in ("key", "part", "chunk", "other")]
        starts = np.flatnonzero(np.append(True, ~np.logical_and.reduce(same))).tolist()
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for begin, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            here = tuple(int(columns[c][begin]) for c in ("key", "part", "chunk"))
            if here != block:
                block, standing = here, []
            for width in np.unique(lengths[begin:end]).tolist():
                rows = begin + np.flatnonzero(lengths[begin:end] == width)
                places = (ends[rows] - width)[:, None] + np.arange(width)
                nodes = {c: columns[c][rows] for c in ("node", "root", "size")} | {"sketch": words[places], "keys": least[rows]}
                if not columns["other"][begin]:
                    standing.append((width, nodes))
                    continue
                for _, first in standing:
                    left, right = _may_link(nodes, first)
                    here_only = ~_met_elsewhere(here[0], nodes["keys"][left], first["keys"][right])
                    left, right = left[here_only], right[here_only]
                    us.append(nodes["node"][left])
                    vs.append(first["node"][right])
        u, v = np.concatenate(us), np.concatenate(vs)
        pairs = np.unique(np.stack((np.maximum(u, v), np.minimum(u, v))), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["u", "v"])


def _blocks(open_: DataFrame, standing: DataFrame, firsts: DataFrame) -> DataFrame:
    """(u, v) of one key where u stands for it and both may link: a key's nodes are dealt over blocks of bounded size, compared there."""
    spark = open_.sparkSession
    # a node has no more keys than its text has shingles
    least = open_.groupBy("node").agg(F.array_sort(F.collect_set("key")).alias("all"))
    filled = F.slice(F.concat("all", F.array_repeat(F.lit(NO_KEY), LEAST_KEYS)), 1, LEAST_KEYS)
    about = firsts.join(least.select("node", filled.alias("keys")), "node").select("node", "size", short_sketch("sketch").alias("sketch"), "keys")
    counts = open_.groupBy("key").agg(F.count("*").alias("n")).join(standing.groupBy("key").agg(F.count("*").alias("n_reps")), "key")
    blocks = counts.selectExpr("key", f"cast(ceil(n / {BLOCK_NODES}) as int) as parts", f"cast(ceil(n_reps / {BLOCK_REPS}) as int) as chunks")
    nodes = open_.join(blocks, "key").withColumn("part", F.expr("cast(pmod(xxhash64(node), parts) as int)"))
    nodes = nodes.withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)"))).withColumn("other", F.lit(1))
    reps = standing.selectExpr("key", "v as node", "root_v as root", f"cast(floor((place - 1) / {BLOCK_REPS}) as int) as chunk").join(blocks, "key")
    reps = reps.withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).withColumn("other", F.lit(0))
    laid = nodes.select("key", "part", "chunk", "other", "node", "root").unionByName(reps.select("key", "part", "chunk", "other", "node", "root")).join(about, "node")
    laid = laid.repartition(partitions(spark), "key", "part", "chunk").sortWithinPartitions("key", "part", "chunk", "other", "node")
    return laid.mapInArrow(giving_back(_meet), "u bigint, v bigint")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: tuple[bytes, np.ndarray] = (b"", np.zeros(0, np.uint64))
    for batch in batches:
        keep = []
        texts = zip(batch.column("text_u").cast(pa.binary()).to_pylist(), batch.column("text_v").cast(pa.binary()).to_pylist(), strict=True)
        for a, b in texts:
            if b != held[0]:
                held = (b, shingles(b))
            own, other = shingles(a), held[1]
            both = len(np.intersect1d(own, other, assume_unique=True))
            keep.append(LIKE[1] * both >= LIKE[0] * (len(own) + len(other) - both))
        yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _wanted(bitmap):
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = bitmap.value
        for batch in batches:
            rows = [k for k, spot in enumerate(batch.column("spot").to_pylist()) if in_bitmap(marked, spot)]
            texts = batch.column("text").take(pa.array(rows, pa.int64())).cast(pa.binary()).to_pylist()
            nodes = [node_of(h) if len(h) else None for h in shingle_sets(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([t.decode() for t in texts], pa.string())], names=["node", "text"])

    return pick


def _links(rows: DataFrame, firsts: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidate pairs (u, v) whose texts really link; only texts that a filter of bounded size lets through are shuffled."""
    spark = rows.sparkSession
    needed = candidates.select(F.col("u").alias("node")).unionByName(candidates.select(F.col("v").alias("node"))).distinct()
    needed = stage(firsts.join(needed, "node", "left_semi").select("node", "doc_id"), "needed")
    bitmap = spark.sparkContext.broadcast(seen_bitmap(needed, "doc_id"))
    found = rows.select("doc_id", "text", bitmap_spot("doc_id").alias("spot")).mapInArrow(giving_back(_wanted(bitmap)), "node bigint, text string")
    texts = stage(found.join(needed.select("node"), "node", "left_semi"), "texts")
    pairs = candidates.join(texts.select(F.col("node").alias("u"), F.col("text").alias("text_u")), "u")
    pairs = pairs.join(texts.select(F.col("node").alias("v"), F.col("text").alias("text_v")), "v")
    return pairs.select("u", "v", "text_u", "text_v").mapInArrow(giving_back(_verify), "u bigint, v bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable by links, its own included), text_key and class of every row.

    Rows of one class are linked by a chain; ``class`` is null without words.

    Null, empty and wordless texts are empty sets, linked with nothing.  Rows
    that share an id are documents of their own, linked if their texts are;
    null ids are never the least unless all are null.
    """
    spark = prepare(docs.sparkSession)
    rows = narrowed(docs, id_col, text_col)
    profile = stage(rows.withColumn("text_key", F.xxhash64("text")).mapInArrow(giving_back(_profile), PROFILE), "profile")
    nodes = profile.where("node is not null")
    firsts = stage(nodes.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("size"), F.first("sketch").alias("sketch")), "nodes")
    groups = meeting_keys(rows)
    roots = None
    turn = 0
    while True:
        reps = REPS_GROWTH**turn
        placed = groups.withColumn("root", F.col("node"))
        if roots is not None:
            placed = groups.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        # keys whose nodes are in one component need no further comparison
        ends = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("node").alias("rep")).where("low <> high")
        open_ = placed.join(ends.select("key", "rep"), "key")
        if reps == 1:
            standing = open_.select("key", F.col("rep").alias("v")).distinct()
            pairs = open_.where("node <> rep").select(F.col("node").alias("u"), F.col("rep").alias("v"))
        else:
            open_ = stage(open_.drop("rep"), "open-keys")
            # least nodes of each key, first within parts of it: no key is ranked as a whole
            part = F.pmod(F.xxhash64("node"), F.lit(64))
            ranked = open_.withColumn("part", part).withColumn("place", F.expr("row_number() over (partition by key, part order by node)"))
            ranked = ranked.where(F.col("place") <= reps).withColumn("place", F.expr("row_number() over (partition by key order by node)"))
            standing = stage(ranked.where(F.col("place") <= reps).select("key", F.col("node").alias("v"), F.col("root").alias("root_v"), "place"), "standing")
            if standing.isEmpty():
                break
            pairs = _blocks(open_, standing, firsts)
        pairs = stage(pairs.distinct(), "pairs")
        if reps == 1 and pairs.isEmpty():
            break
        about = firsts.select("node", "size", "sketch")
        filtered = pairs.join(about.selectExpr("node as u", "size as size_u", "sketch as sketch_u"), "u").join(
            about.selectExpr("node as v", "size as size_v", "sketch as sketch_v"), "v"
        )
        filtered = filtered.where(F.least("size_u", "size_v") * LIKE[1] >= F.greatest("size_u", "size_v") * LIKE[0])
        filtered = filtered.where(hamming("sketch_u", "sketch_v") * (LIKE[0] + LIKE[1]) <= (F.col("size_u") + F.col("size_v")) * (LIKE[1] - LIKE[0]))
        candidates = stage(filtered.select("u", "v"), "candidates")
        links = stage(_links(rows, firsts, candidates), "verified")
        if not links.isEmpty():
            if roots is None:
                roots = connected(links)
            else:  # only components are joined from here on
                root_of = lambda c: F.coalesce(f"root_{c}", c)
                lifted = links
                for c in ("u", "v"):
                    lifted = lifted.join(roots.selectExpr(f"node as {c}", f"root as root_{c}"), c, "left")
                joined = connected(lifted.select(root_of("u").alias("u"), root_of("v").alias("v"))).selectExpr("node as old", "root as new")
                known = roots.join(joined, roots["root"] == joined["old"], "left").select("node", F.coalesce("new", "root").alias("root"))
                fresh = joined.join(roots, joined["old"] == roots["node"], "left_anti").selectExpr("old as node", "new as root")
                roots = stage(known.unionByName(fresh), "roots")
        # who has stood for a key has been compared with all of it
        groups = stage(open_.select("key", "node").join(standing.select("key", F.col("v").alias("node")), ["key", "node"], "left_anti"), "groups")
        turn += 1
    placed = profile.select("doc_id", "text_key", "n_shingles", "node")
    if roots is not None:
        placed = placed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    else:
        placed = placed.withColumn("root", F.col("node"))
    least = placed.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    out = placed.join(least.drop("n"), "root", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), "text_key", F.col("root").alias("class"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: that of the least id (null last), of equal ids one text.

    Rows without words are in no class and stay, but rows that agree in id and text stay once.
    """
    links = stage(near_duplicates(docs).select("doc_id", "text_key", "class"), "classes")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_key"))).alias("first")
    kept = links.where("class is not null").groupBy("class").agg(first).select("first.doc_id", "first.text_key")
    kept = kept.unionByName(links.where("class is null").select("doc_id", "text_key").distinct())
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = packed(docs, id=F.col("doc_id").cast("bigint"), key=F.xxhash64(text))
    met = rows.join(kept, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key")), "left_semi")
    return met.dropDuplicates(["id", "key"]).select("row.*")
