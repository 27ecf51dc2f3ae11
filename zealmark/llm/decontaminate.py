"""Benchmark passages in documents, by a prefix-filtered join over item-sized windows.

An item's windows (``window`` consecutive words, or the whole item if it is shorter) are
records of words.  Words are ordered by how rare they are in the corpus.  As
a window must be contained whole, its prefix is its rarest word: a document
that lacks that word lacks the window.  A document word that is such a prefix
proposes the window at the place it must then stand; length and position bounds
discard what would reach over an end of the document, and a comparison of the words
decides.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zealmark.llm.common import byte_list, giving_back, narrowed, prepare

WINDOW = 10
# An index slice covers about so many bytes of benchmark text; further slices are loaded one after the other.
SLICE_BYTES = 8_000_000
# A-Z become small; everything but digits, small letters and bytes of non-ASCII code points separates words
_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
SEPARATED = bytes(c if c >= 0x80 or c in _KEPT else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def bench_words(text: bytes) -> list[bytes]:
    """Words of letters, digits and non-ASCII code points, A-Z in lower case."""
    return text.translate(SEPARATED).split()


def _slices(benchmark: DataFrame, item_col: str, text_col: str) -> list[DataFrame]:
    """The benchmark in parts of about SLICE_BYTES; each part reaches the driver by itself."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 64).alias("n")).first().n or 0
    n = max(1, -(-size // SLICE_BYTES))
    return [items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i) for i in range(n)]


def _count_known(vocabulary):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pickle.loads(vocabulary.value)
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column("text").cast(pa.binary()):
                seen.update(filter(known.__contains__, bench_words(text.as_py())))
        if seen:
            yield pa.RecordBatch.from_pydict({"word": list(seen), "n": list(seen.values())})

    return count


def index_windows(items: list[tuple[str, bytes]], rarity: dict[bytes, int], window: int = WINDOW) -> dict[bytes, list[tuple[int, list[bytes], list[str]]]]:
    """Prefix word -> (its place in the window, the window's words, the items that hold it); the first of equally rare words is the prefix."""
    holders: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for item, text in items:
        words = bench_words(text)
        if words:
            for at in range(max(1, len(words) - window + 1)):
                holders[tuple(words[at : at + window])].add(item)
    index: dict[bytes, list[tuple[int, list[bytes], list[str]]]] = defaultdict(list)
    for words, found_in in sorted(holders.items()):
        place = min(range(len(words)), key=lambda i: (rarity.get(words[i], 0), words[i], i))
        index[words[place]].append((place, list(words), sorted(found_in)))
    return dict(index)


def find_windows(words: list[bytes], index: dict[bytes, list[tuple[int, list[bytes], list[str]]]]) -> tuple[list[tuple[int, int]], set[str]]:
    """Spans [begin, end) of all window occurrences, and the items whose windows occur."""
    spans, items = [], set()
    for at, word in enumerate(words):
        if word in index:
            for place, wanted, found_in in index[word]:
                begin = at - place
                if begin >= 0 and begin + len(wanted) <= len(words) and words[begin : begin + len(wanted)] == wanted:
                    spans.append((begin, begin + len(wanted)))
                    items.update(found_in)
    return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


OUT = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<first:bigint,past:bigint>>"


def find_benchmark(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """Per document: n_words, n_hit (words inside any occurrence), n_items, items_sha256, contaminated, items, spans (word places).

    The documents are read twice (rarity of the benchmark's words, then the
    search) and never shuffled.  The index goes to the executors in slices of
    at most about SLICE_BYTES of benchmark text each; a task holds one
    slice at a time and passes each batch of documents over all of them, so a
    large benchmark costs time and not memory.  Null or wordless texts have no
    hits; null or wordless items are found nowhere; item ids are compared as strings and a null id counts
    as the empty one.
    """
    rows = narrowed(docs, id_col, text_col)
    find = _finder(rows, benchmark, window, item_col, item_text_col)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = find()
        for batch in batches:
            lengths, found = held(byte_list(batch, "text"))
            whole = [merged(spans) for spans, _ in found]
            names = [sorted(items) for _, items in found]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_words": lengths,
                    "n_hit": [sum(end - begin for begin, end in spans) for spans in whole],
                    "n_items": [len(items) for items in names],
                    "items_sha256": [hashlib.sha256(",".join(items).encode()).hexdigest() for items in names],
                    "contaminated": [bool(spans) for spans in whole],
                    "items": pa.array(names, pa.list_(pa.string())),
                    "spans": pa.array([[{"first": b, "past": e} for b, e in spans] for spans in whole], pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))),
                }
            )

    return rows.mapInArrow(search, OUT)


def _finder(rows: DataFrame, benchmark: DataFrame, window: int, item_col: str, item_text_col: str):
    """For a task: the function that gives word counts, and spans with items, of a batch of texts; ``rows`` (text) say how rare words are."""
    spark = prepare(rows.sparkSession)
    shipped = []
    for part in _slices(benchmark, item_col, item_text_col):
        items = [(row.item or "", row.text.encode()) for row in part.collect()]
        vocabulary = spark.sparkContext.broadcast(pickle.dumps({word for _, text in items for word in bench_words(text)}))
        counted = rows.select("text").mapInArrow(_count_known(vocabulary), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
        rarity = {bytes(row.word): row.n for row in counted.collect()}  # at most the slice's vocabulary
        shipped.append(spark.sparkContext.broadcast(pickle.dumps(index_windows(items, rarity, window))))

    def start():
        held: list[tuple[int, dict]] = []

        def found_in(texts: list[bytes]) -> tuple[list[int], list[tuple[list, set]]]:
            found: list[tuple[list, set]] = [([], set()) for _ in texts]
            lengths = [0] * len(texts)
            for number, slice_ in enumerate(shipped):
                if not held or held[0][0] != number:
                    held[:] = [(number, pickle.loads(slice_.value))]
                for k, (text, (spans, items)) in enumerate(zip(texts, found, strict=True)):
                    words = bench_words(text)
                    lengths[k] = len(words)
                    more, of = find_windows(words, held[0][1])
                    spans += more
                    items |= of
            return lengths, found

        return found_in

    return start


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark window.

    Each row is decided by its own text, so columns of any name, repeated and missing ids stay as they are.
    """
    find = _finder(narrowed(docs, "doc_id", "text"), benchmark, window, "item_id", "text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = find()
        for batch in batches:
            _, found = held([text or b"" for text in byte_list(batch, "text")])
            yield batch.filter(pa.array([not spans for spans, _ in found], pa.bool_()))

    return docs.mapInArrow(giving_back(keep), docs.schema)
