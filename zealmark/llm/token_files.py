"""Token ids in flat unsigned integer files with 64-bit document offsets.

A shard is three files that can be memory-mapped: ``.ids`` (all ids, little-endian
uint16 if the vocabulary allows it and uint32 otherwise), ``.offsets`` (int64, one
more than documents, counted from the shard's first id) and ``.docs`` (int64 document
ids, the least int64 for null).  ``manifest.json`` lists the shards in document
order with their bases, the prefix sums of the shards' sizes.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from zealmark.llm.common import give_back_memory, narrowed, opened, partitions, prepare
from zealmark.session import scratch_path

NULL_ID = -(2**63)
CACHED_PIECES = 600_000  # about 200 bytes each; a worker starts anew beyond that
JOINED = 1000  # words that are encoded as one text
AT_ONCE = 1 << 21  # bytes of texts that are encoded together
READ_IDS = 1 << 20
SHARDS = "shard bigint, name string, n_docs bigint, n_ids bigint, id_bytes bigint"


# Pieces of a text whose ids can be found one by one: a word that ends with an ASCII letter, the punctuation that ends
# its run of non-space, or else the whole run. Quotes and the brackets of control tokens never part.
_TAIL = rb"[!-&(-/:;=?@\[-`{}~]"
_TAIL_BYTES = bytes(c for c in range(128) if re.fullmatch(_TAIL, bytes([c])))
PIECES = re.compile(rb"[A-Za-z\x80-\xff]*[A-Za-z](?=" + _TAIL + rb"*(?:[ \t\n\r]|\Z))|" + _TAIL + rb"+(?=[ \t\n\r]|\Z)|[^ \t\n\r]+")
# How control tokens begin, and what a group of texts is cut by: white space, punctuation that may end a run, ASCII letters, all other bytes
_CONTROL = b"<|"
_SPACE, _END, _LETTER, _OTHER = range(4)
_KINDS = bytes(
    _SPACE if c in b" \t\n\r" else _END if c in _TAIL_BYTES else _LETTER if bytes([c]).isalpha() else _OTHER for c in range(256)
)
_ENCODERS: dict[tuple[str, int], Encoder] = {}  # one per Python worker, kept from task to task


def _latin(piece: bytes) -> bool:
    """Whether a piece is a word of Latin-1 letters alone."""
    if piece.isascii():
        return piece.isalpha()
    text = piece.decode()
    return text.isalpha() and max(text) <= "\xff"


def _parts(run: bytes) -> list[bytes]:
    """What a new run is encoded as: a word of Latin-1 letters in lower case, apart from the punctuation that ends it, or else its pieces."""
    head = run.rstrip(_TAIL_BYTES)
    if not _latin(head):
        return [piece.decode().lower().encode() if _latin(piece) else piece for piece in PIECES.findall(run)]
    word = head.lower() if head.isascii() else head.decode().lower().encode()
    return [word, run[len(head) :]] if len(head) < len(run) else [word]


def _cut(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The runs of a group of texts one after the other, and how many stand before each text and in all.

    A single mark of punctuation between an ASCII letter and white space is a run of its own.  ASCII letters come in
    lower case, but for those before a code point that may combine with them, and for all beside a control token.
    """
    whole = b" ".join([b"", *texts, b""])
    data = np.frombuffer(whole, np.uint8)
    kind = np.frombuffer(whole.translate(_KINDS), np.uint8)
    solid = kind != _SPACE
    begins = np.zeros(len(data), bool)
    begins[1:] = solid[1:] & ~solid[:-1]
    begins[1:-1] |= (kind[1:-1] == _END) & (kind[:-2] == _LETTER) & ~solid[2:]
    if _CONTROL not in whole:
        capital = data - np.uint8(ord("A")) < 26
        capital[:-1] &= data[1:] < 0xC4  # Latin-1 ends here in UTF-8; no code point of it combines
        data = data + (capital.view(np.uint8) << 5)
    held = data[solid]
    at = np.flatnonzero(begins)
    offsets = np.append(np.cumsum(solid, dtype="<i4")[at] - 1, len(held)).astype("<i4")
    firsts = 1 + np.cumsum([0, *[len(text) + 1 for text in texts]])
    runs = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(held)])
    return runs, np.searchsorted(at, firsts)


class Encoder:
    """Ids of whole texts, put together from the ids of their pieces.

    For a tokenizer that never joins across white space or from a letter to
    punctuation (``word_bpe_49k``: its splitting pattern takes letters, digits and
    the rest apart) the ids of a text are those of its pieces in a row.  Text is cut into runs at
    space, tab and line ends, which every rule of the tokenizer counts as white space, and before the mark that
    ends a word.  Each different run of a group of texts is looked up once; those that are new to the worker are
    cut into pieces, these are encoded, and both are looked up from then on.  Latin-1 words differ by case in no
    id.  Control tokens do, so a group that may hold one keeps its case.
    """

    def __init__(self, path: str, id_bytes: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype(f"<u{id_bytes}")
        self.known: dict[bytes, bytes] = {}

    @staticmethod
    def of(path: str, id_bytes: int) -> Encoder:
        if (path, id_bytes) not in _ENCODERS:
            _ENCODERS[path, id_bytes] = Encoder(path, id_bytes)
        return _ENCODERS[path, id_bytes]

    def _apart(self, pieces: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch([p.decode() for p in pieces], add_special_tokens=False)
        return [np.array(x.ids, self.kind).tobytes() for x in found]

    def _joined(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of Latin-1 letters, encoded as one text; each is one word of the tokenizer too."""
        found = self.tokenizer.encode(" ".join([w.decode() for w in words]), add_special_tokens=False)
        ends = ((np.flatnonzero(np.diff(found.word_ids, append=-1)) + 1) * self.kind.itemsize).tolist()
        if len(ends) != len(words):
            return self._apart(words)
        data = np.array(found.ids, self.kind).tobytes()
        return [data[begin:end] for begin, end in zip([0, *ends[:-1]], ends, strict=True)]

    def _learn(self, new: set[bytes]) -> None:
        if len(self.known) + 3 * len(new) > CACHED_PIECES:
            self.known.clear()
        folded = {run: _parts(run) for run in new}
        wanted = [p for p in {part for parts in folded.values() for part in parts} if p not in self.known]
        words, others = [], []
        for part in wanted:
            (words if _latin(part) else others).append(part)
        for at in range(0, len(words), JOINED):
            part = words[at : at + JOINED]
            self.known.update(zip(part, self._joined(part), strict=True))
        self.known.update(zip(others, self._apart(others), strict=True))
        self.known.update({run: b"".join(map(self.known.__getitem__, parts)) for run, parts in folded.items()})

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        runs, firsts = _cut(texts)
        coded = runs.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, names))
        gaps = [at for at, ids in enumerate(found) if ids is None]
        if gaps:
            self._learn({names[at] for at in gaps})
            for at in gaps:
                found[at] = self.known[names[at]]
        offsets = np.concatenate([[0], np.cumsum(list(map(len, found)), dtype="<i8")]).astype("<i8")
        by_name = pa.Array.from_buffers(pa.large_binary(), len(found), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(found))])
        _, ends, data = by_name.take(coded.indices).buffers()
        bounds = np.frombuffer(ends, "<i8")[firsts].tolist()
        ids = memoryview(data or b"")
        return [bytes(ids[begin:end]) for begin, end in zip(bounds[:-1], bounds[1:], strict=True)]

    def encode(self, text: bytes) -> bytes:
        return self.encode_all([text])[0]


def id_width(tokenizer_path: str, end_id: int) -> int:
    """2 if every id and the end id fit 16 bits, else 4."""
    from tokenizers import Tokenizer

    highest = max([end_id, *Tokenizer.from_file(tokenizer_path).get_vocab(with_added_tokens=True).values()])
    return 2 if highest < 2**16 else 4


def _groups(texts: pa.Array) -> Iterator[list[bytes]]:
    """Texts in their order, in groups that end with the text that reaches AT_ONCE bytes."""
    held, size = [], 0
    for text in texts:
        held.append(text.as_py())
        size += len(held[-1])
        if size >= AT_ONCE:
            yield held
            held, size = [], 0
    if held:
        yield held


def _writer(folder: str, tokenizer_path: str, end_id: int, id_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer_path, id_bytes)
        end = np.array([end_id], f"<u{id_bytes}").tobytes()
        fs, root = opened(folder)
        shard, name, files, n_docs, n_ids = TaskContext.get().partitionId(), "", [], 0, 0
        for batch in batches:
            if not files:
                name = f"shard-{shard:06d}-{uuid.uuid4().hex}"
                files = [fs.open_output_stream(f"{root}/{name}.{kind}", compression=None) for kind in ("ids", "offsets", "docs")]
                files[1].write(np.zeros(1, "<i8").tobytes())
            lengths = []
            for texts in _groups(batch.column("text").cast(pa.binary())):
                ids = encoder.encode_all(texts)
                files[0].write(end.join([*ids, b""]))
                lengths += [len(of_text) // id_bytes + 1 for of_text in ids]
            files[1].write((n_ids + np.cumsum(lengths, dtype="<i8")).tobytes())
            docs = batch.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            files[2].write(docs.astype("<i8").tobytes())
            n_docs, n_ids = n_docs + batch.num_rows, n_ids + int(sum(lengths))
        for file in files:
            file.close()
        if files:
            yield pa.RecordBatch.from_pydict({"shard": [shard], "name": [name], "n_docs": [n_docs], "n_ids": [n_ids], "id_bytes": [id_bytes]})

    return write


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Encode every whole text (null: empty), end each with ``end_id``, and write ids in ascending document order, null ids first.

    Rows that share an id stand in the order of their texts.  One range
    partition is one shard; its files carry a name of their own per task
    attempt, and the manifest lists those of the successful attempts.  Returns
    the manifest: one entry per shard, so as long as there are partitions.
    """
    spark = docs.sparkSession
    prepare(spark)
    fs, root = opened(folder)
    fs.create_dir(root, recursive=True)
    id_bytes = id_width(tokenizer_path, end_id)
    ordered = narrowed(docs, id_col, text_col).repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    written = ordered.mapInArrow(_writer(folder, tokenizer_path, end_id, id_bytes), SHARDS).collect()
    manifest, base = [], 0
    for row in sorted(written, key=lambda row: row.shard):
        manifest.append(row.asDict() | {"base": base, "path": f"{folder}/{row.name}"})
        base += row.n_ids
    with fs.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def _mapped(uri: str, kind: str, at: int, n: int) -> np.ndarray:
    """``n`` numbers from place ``at`` of a file: memory-mapped where the file system is local, else only that range is read."""
    fs, path = opened(uri)
    if fs.type_name == "local":
        return np.memmap(path, kind, "r", at * np.dtype(kind).itemsize, (n,)) if n else np.empty(0, kind)
    with fs.open_input_file(path) as file:
        return np.frombuffer(file.read_at(n * np.dtype(kind).itemsize, at * np.dtype(kind).itemsize), kind)


READ = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if _ENCODERS:  # the files are written, so what this worker kept for that can go
        _ENCODERS.clear()
        give_back_memory()
    for batch in batches:
        for shard in batch.to_pylist():
            kind = f"<u{shard['id_bytes']}"
            for first in range(0, shard["n_docs"], 10_000):
                n = min(10_000, shard["n_docs"] - first)
                offsets = np.array(_mapped(f"{shard['path']}.offsets", "<i8", first, n + 1))
                docs = np.array(_mapped(f"{shard['path']}.docs", "<i8", first, n))
                sums, held, held_at = [], np.empty(0, kind), 0
                for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    crc = 0
                    for at in range(begin, end, READ_IDS):
                        stop = min(end, at + READ_IDS)
                        if stop > held_at + len(held):
                            held, held_at = _mapped(f"{shard['path']}.ids", kind, at, min(2 * READ_IDS, shard["n_ids"] - at)), at
                        crc = zlib.crc32(held[at - held_at : stop - held_at].astype("<u4").tobytes(), crc)
                    sums.append(crc)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs, mask=docs == NULL_ID),
                        pa.array(shard["base"] + offsets[:-1]),
                        pa.array(np.diff(offsets)),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )


def read_tokens(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """One row per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (over the ids as uint32)."""
    columns = "shard bigint, n_docs bigint, n_ids bigint, id_bytes bigint, base bigint, path string"
    rows = [tuple(entry[c.split()[0]] for c in columns.split(", ")) for entry in manifest]
    return spark.createDataFrame(rows, columns).repartition(max(1, len(rows)), "shard").mapInArrow(_reader, READ)


def tokenize_corpus(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write the corpus into the shared folder and read it back; an empty table gives no rows."""
    return read_tokens(spark, write_tokens(docs, scratch_path(spark, "tokens"), tokenizer_path, end_id))
