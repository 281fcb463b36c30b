"""Operator 5: token ids in Arrow files of fixed-size lists.

Documents are range-partitioned by id; each task encodes its run of documents
with a `tokenizers` vocabulary, appends the end id to each, and writes two
files to the shared folder: the ids packed into sequences of one length with
their masks (the last sequence is padded), and the documents' places. The
files map into memory, so any sequence or mask is a slice of the mapped bytes.

The library encodes whole texts. Where the tokenizer file itself shows that it
never joins text across white space or between letters and marks (its
pre-tokenizer keeps words, digits and marks apart and drops white space; see
`cuttable`), texts are cut there and each distinct piece is encoded once.
Documents that hold the string of one of the file's added tokens, in any case,
are always encoded whole. Tests hold the result against the library on whole
texts for both kinds of file. A retried task writes its file anew under the
same name, with the same bytes.

Null and empty texts are the end id alone. Rows with equal ids follow each
other in the order of a hash of their text; null ids come first. Very long
texts are encoded whole. An empty table gives no file and an empty result;
further columns are not read.
"""

from __future__ import annotations

import json
import os
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, scratch, text_columns
from .text import IS_SPACE_WORD, LOWER, Words, chunks, flat

#: Ids in a sequence and sequences in a record batch.
LENGTH, BATCH = 2048, 256
#: Distinct pieces that a Python worker remembers.
REMEMBERED = 300_000

_encoders: dict[str, PieceEncoder] = {}

#: The split pattern under which words, single digits and runs of marks are always apart.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Normalisers that work on each piece as they do on the whole text.
LOCAL = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"})

# Places between ASCII letters or digits and these marks, where that pattern always splits.
_MARKS = np.isin(np.arange(256), [ord(c) for c in ".,;:!?#$%&*()"])
_PLAIN = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
_CUTS = (_PLAIN[:, None] & _MARKS[None, :]) | (_MARKS[:, None] & _PLAIN[None, :])


def cuttable(spec: dict) -> bool:
    """Whether a tokenizer file shows that cutting texts at white space and at _CUTS changes no id."""
    normal = spec.get("normalizer") or {"type": "Sequence", "normalizers": []}
    normal = normal["normalizers"] if normal["type"] == "Sequence" else [normal]
    split = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    words = split[0].get("type") == "Split" and split[0]["pattern"] == {"Regex": WORD_PATTERN} and split[0]["behavior"] == "Removed" and split[0]["invert"]
    bytes_ = all(s["type"] == "ByteLevel" and not s["use_regex"] and not s["add_prefix_space"] for s in split[1:])
    return bool(words and bytes_ and all(n in LOCAL for n in normal) and not spec.get("post_processor") and not spec.get("truncation") and not spec.get("padding") and not spec["model"].get("dropout"))


class PieceEncoder:
    """Encodes documents with a tokenizer file; where texts may be cut, each distinct piece once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.cuttable = cuttable(spec)
        self.lower = self.cuttable and LOCAL[2] in (spec["normalizer"] or {}).get("normalizers", [])
        self.added = [t["content"].lower().encode() for t in spec["added_tokens"]]
        self.known: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, path: str) -> PieceEncoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def pieces(self, values: list[bytes]) -> list[bytes]:
        """The ids of each piece; new ones go to the library as the words of one pre-split text."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = [v for v in values if v not in known]
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            found = self.tokenizer.encode([v.decode() for v in part], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(found.ids, self.kind)
            word = np.array(found.word_ids, np.int64)
            edge = np.searchsorted(word, np.arange(len(part) + 1))
            raw, size = ids.tobytes(), self.kind.itemsize
            for v, a, b in zip(part, (edge[:-1] * size).tolist(), (edge[1:] * size).tolist(), strict=True):
                known[v] = raw[a:b]
        return [known[v] for v in values]

    def _holding_added(self, data: np.ndarray, offs: np.ndarray) -> list[int]:
        """Documents that hold the string of an added token, whatever its case."""
        raw, found = LOWER[data].tobytes(), set()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                found.add(int(np.searchsorted(offs, at, side="right")) - 1)
                at = raw.find(token, at + 1)
        return sorted(found)

    def _whole(self, texts: list[str], end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        tail = [] if end_id is None else [end_id]
        runs = [np.array(e.ids + tail, self.kind) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, self.kind), *runs]), np.array([len(r) for r in runs], np.int64)

    def _cut(self, data: np.ndarray, offs: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        words = Words(data, offs, IS_SPACE_WORD, lower=self.lower, cuts=_CUTS)
        coded = words.values().dictionary_encode()
        blobs = self.pieces(coded.dictionary.to_pylist())
        return gather(blobs, self.kind, coded.indices.to_numpy(zero_copy_only=False), words.counts, end_id)

    def documents(self, data: np.ndarray, offs: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the documents one after another, and the number of each."""
        n = len(offs) - 1
        whole = self._holding_added(data, offs) if self.cuttable else range(n)
        parts, i = [], 0
        for k in [*whole, n]:
            if k > i:
                parts.append(self._cut(data[offs[i] : offs[k]], offs[i : k + 1] - offs[i], end_id))
            if k < n:
                parts.append(self._whole([data[offs[k] : offs[k + 1]].tobytes().decode()], end_id))
            i = k + 1
        return np.concatenate([np.zeros(0, self.kind), *(p[0] for p in parts)]), np.concatenate([np.zeros(0, np.int64), *(p[1] for p in parts)])


def gather(blobs: list[bytes], kind: np.dtype, index: np.ndarray, counts: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The id runs `blobs[index]`, split into documents of `counts` runs."""
    if end_id is not None:
        blobs = [*blobs, np.array([end_id], kind).tobytes()]
        stops = np.cumsum(counts) + np.arange(len(counts))
        full = np.full(len(index) + len(counts), len(blobs) - 1, np.int64)
        inside = np.ones(len(full), bool)
        inside[stops] = False
        full[inside] = index
        index, counts = full, counts + 1
    flat_ids = np.frombuffer(b"".join(blobs), kind)
    size = np.array([len(b) // kind.itemsize for b in blobs], np.int64)
    start = np.cumsum(size) - size
    runs = size[index]
    before = np.concatenate([[0], np.cumsum(runs)])
    ids = flat_ids[np.repeat(start[index] - before[:-1], runs) + np.arange(before[-1])]
    return ids, np.diff(before[np.concatenate([[0], np.cumsum(counts)])])


@dataclass(frozen=True)
class TokenFile:
    """One written file: where its ids and its index lie, and the ids of all files before it."""

    part: int
    path: str
    index: str
    n_tokens: int
    start: int


class Reader:
    """Random access to the sequences of a file."""

    def __init__(self, path: str):
        fs, name = filesystem(path)
        source = pa.memory_map(name) if fs.type_name == "local" else fs.open_input_file(name)
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size
        self.per_batch = int(self.file.schema.metadata[b"batch"])

    def __len__(self) -> int:
        n = self.file.num_record_batches
        return (n - 1) * self.per_batch + self.file.get_batch(n - 1).num_rows if n else 0

    def _values(self, k: int, column: str) -> pa.Array:
        batch = self.file.get_batch(k // self.per_batch)
        at = k % self.per_batch * self.length
        return batch.column(column).values.slice(at, self.length)

    def sequence(self, k: int) -> np.ndarray:
        """The ids of sequence k, a view of the mapped file."""
        return self._values(k, "ids").to_numpy(zero_copy_only=True)

    def mask(self, k: int) -> pa.BooleanArray:
        """True for ids, False for padding; a slice of the mapped bits."""
        return self._values(k, "mask")

    def stream(self) -> Iterator[np.ndarray]:
        for k in range(self.file.num_record_batches):
            yield self.file.get_batch(k).column("ids").values.to_numpy(zero_copy_only=True)


class _Writer:
    def __init__(self, path: str, kind: np.dtype, length: int):
        self.fs, self.final = filesystem(path)
        self.temporary = f"{self.final}.{uuid.uuid4().hex}"
        self.length, self.kind = length, kind
        item = pa.uint16() if kind.itemsize == 2 else pa.uint32()
        self.item = item
        self.schema = pa.schema([("ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length))], metadata={"batch": str(BATCH)})
        self.sink = self.fs.open_output_stream(self.temporary)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.rest: list[np.ndarray] = []
        self.waiting = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.rest.append(ids)
        self.waiting += len(ids)
        self.total += len(ids)
        if self.waiting >= BATCH * self.length:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, self.kind)
        step = BATCH * self.length
        at = 0
        while len(ids) - at >= step:
            self._batch(ids[at : at + step], step)
            at += step
        if last and len(ids) > at:
            part = ids[at:]
            self._batch(np.concatenate([part, np.zeros(-len(part) % self.length, self.kind)]), len(part))
            at = len(ids)
        self.rest = [ids[at:]]
        self.waiting = len(ids) - at

    def _batch(self, ids: np.ndarray, real: int) -> None:
        lists = pa.FixedSizeListArray.from_arrays(pa.array(ids, self.item), self.length)
        mask = pa.FixedSizeListArray.from_arrays(pa.array(np.arange(len(ids)) < real), self.length)
        self.out.write_batch(pa.RecordBatch.from_arrays([lists, mask], schema=self.schema))

    def close(self) -> None:
        self._flush(True)
        self.out.close()
        self.sink.close()
        self.fs.move(self.temporary, self.final)


def write_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2, length: int = LENGTH, folder: str | None = None) -> list[TokenFile]:
    """Writes the token files and returns them in document order (one for each partition)."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")
    fs, name = filesystem(folder)
    fs.create_dir(name, recursive=True)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = text_columns(docs, id_col, text_col).repartitionByRange(n, "doc_id").withColumn("o", F.xxhash64("text")).sortWithinPartitions("doc_id", "o").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.of(tokenizer)
        part = TaskContext.get().partitionId()
        path, index = posixpath.join(folder, f"part-{part:06d}.arrow"), posixpath.join(folder, f"part-{part:06d}.index.arrow")
        out, places = None, []
        for batch in batches:
            data, offs = flat(batch.column(1))
            for i, j in chunks(offs):
                ids, sizes = encoder.documents(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], end_id)
                out = out or _Writer(path, encoder.kind, length)
                places.append((batch.column(0).slice(i, j - i), sizes))
                out.add(ids)
        if out is None:
            return
        out.close()
        sizes = np.concatenate([s for _, s in places])
        fs, name = filesystem(index)
        table = pa.table({"doc_id": pa.chunked_array([d for d, _ in places]), "start": np.cumsum(sizes) - sizes, "n_tokens": sizes})
        temporary = f"{name}.{uuid.uuid4().hex}"
        with fs.open_output_stream(temporary) as sink, pa.ipc.new_file(sink, table.schema) as writer:
            writer.write_table(table)
        fs.move(temporary, name)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path], "index": [index], "n": pa.array([out.total], pa.int64())})

    found = sorted(tuple(r) for r in rows.mapInArrow(write, "part int, path string, index string, n long").collect())
    files, start = [], 0
    for part, path, index, total in found:
        files.append(TokenFile(part, path, index, total, start))
        start += total
    return files


def read_tokens(spark: SparkSession, files: list[TokenFile]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not files:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame([(f.path, f.index, f.start) for f in files], "path string, index string, start long").repartition(len(files))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, index, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, name = filesystem(index)
                with fs.open_input_file(name) as source:
                    places = pa.ipc.open_file(source).read_all()
                sums, stream, now = [], Reader(path).stream(), np.zeros(0, np.uint16)
                for left in places["n_tokens"].to_pylist():
                    crc = 0
                    while left:
                        if not len(now):
                            now = next(stream)
                        take = now[:left]
                        crc = zlib.crc32(take.astype("<u4").tobytes(), crc)
                        left, now = left - len(take), now[len(take) :]
                    sums.append(crc)
                places = places.combine_chunks()
                yield pa.RecordBatch.from_arrays(
                    [places["doc_id"].combine_chunks(), pa.array(places["start"].to_numpy() + base, pa.int64()), places["n_tokens"].combine_chunks().cast(pa.int64()), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return listed.mapInArrow(read, schema)
