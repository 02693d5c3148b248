"""Token ids in Arrow files of equal-length sequences.

The documents, in ascending doc_id order, form one stream of token ids, each document closed by an end id.  Every
partition writes a file in the Arrow file format: record batches with two fixed-size-list columns, ``ids`` (16-bit where
the vocabulary allows) and ``mask`` (false on the padding of a file's last sequence), so a memory map reaches any sequence
without a copy.  A second file beside it holds where each document starts.

Cases: null text is empty text (only the end id); null doc_id comes first; rows of equal doc_id are ordered by their texts' bytes,
hash and value, may fall into several files, and each keeps a row; an empty table writes no file and returns no row; other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

FILES = "part long, path string, n_docs long, n_tokens long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"

_coders: dict[tuple, _Coder] = {}
#: Fixed values.  How a tokenizer normalises and cuts whose words of Latin-1 characters are cut by _PIECES.
_CUTS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)
#: Words of printable ASCII and the letters of Latin-1 (U+00C0 to U+00FF but for U+00D7 and U+00F7).
_LATIN = re.compile(rb"(?:[!-~]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF])+").fullmatch
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xDF-\xF6\xF8-\xFF]+|[0-9]|[^a-z\xDF-\xF6\xF8-\xFF0-9]+").findall
#: A letter of Latin-1 as the byte-level alphabet writes its two bytes: bytes up to 0xA0 as the characters from U+0100 + 0x22 on, 0xAD
#: as the one after them, others as themselves.
_BYTES = {c: "".join(chr(b) if b > 0xA0 and b != 0xAD else chr(0x143) if b == 0xAD else chr(b + 0xA2) for b in chr(c).encode()) for c in range(0xC0, 0x100)}
_SLICE = 2 << 20


class _Known(dict):
    """Word -> its ids as bytes; a word that isn't there is encoded."""

    def __init__(self, add: Callable[[bytes], bytes], *items) -> None:
        super().__init__(*items)
        self.add = add

    def __missing__(self, word: bytes) -> bytes:
        out = self[word] = self.add(word)
        return out


class _Coder:
    """Encodes texts word by word and remembers the ids of words.

    The tokenizer lower-cases and never joins across white space, so the ids of a text are those of its words in turn.  It cuts a word
    into pieces and encodes each by itself: a word of Latin-1 letters, digits and marks is cut here by the same pattern and only its new
    pieces go to the tokenizer's model.  All other words go through the whole tokenizer, and so does every word of a tokenizer that
    normalises or cuts in another way."""

    def __init__(self, path: str, most: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        special = [re.escape(t.content.lower().encode()) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(special) or b"(?!)").search
        self.known = _Known(self.add)
        said = json.loads(self.tokenizer.to_str())
        self.cuts = (said["normalizer"], said["pre_tokenizer"]) == _CUTS and said["model"]["type"] == "BPE" and not said["model"]["dropout"]
        self.pieces = self.tokenizer.model.tokenize

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as bytes."""
        if len(self.known) > self.most:
            self.trim(self.most // 2)
        out = []
        for text in texts:
            low = text.lower()  # but a special token's own spelling is told apart by case
            out.append(b"".join(map(self.known.__getitem__, (text if self.special(low) else low).split())))
        return out

    def add(self, word: bytes) -> bytes:
        if not self.cuts or not _LATIN(word) or self.special(word.lower()):
            return array(self.code, self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()
        if word.isalpha() and word.islower():
            return array(self.code, [t.id for t in self.pieces(word.decode())]).tobytes()
        return b"".join(map(self.piece, _PIECES(word.decode().lower())))

    def piece(self, text: str) -> bytes:
        key = text.encode()
        ids = self.known.get(key)
        if ids is None:
            ids = self.known[key] = array(self.code, [t.id for t in self.pieces(text if text.isascii() else text.translate(_BYTES))]).tobytes()
        return ids

    def trim(self, most: int) -> None:
        """Between tasks only the words that came first stay, the frequent ones among them: a worker lives on with other work."""
        if len(self.known) > most:
            self.known = _Known(self.add, islice(self.known.items(), most))


def coder(path: str, most: int = 400_000) -> _Coder:
    """One for each Python worker; most: words it remembers beside those of one slice."""
    if (path, most) not in _coders:
        _coders[path, most] = _Coder(path, most)
    return _coders[path, most]


def arrow_type(kind: np.dtype) -> pa.DataType:
    return pa.from_numpy_dtype(kind)


class _Writer:
    """Cuts the ids it gets into sequences and writes full record batches."""

    def __init__(self, sink, kind: np.dtype, length: int, per_batch: int) -> None:
        self.kind, self.length, self.size = kind, length, length * per_batch
        self.schema = pa.schema([("ids", pa.list_(arrow_type(kind), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out, self.held, self.n = pa.ipc.new_file(sink, self.schema), bytearray(), 0

    def add(self, ids: bytes) -> None:
        self.held += ids
        step = self.size * self.kind.itemsize
        while len(self.held) >= step:
            self._batch(np.frombuffer(bytes(self.held[:step]), self.kind), self.size)
            del self.held[:step]
        self.n += len(ids) // self.kind.itemsize

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.out.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        if self.held:
            ids = np.frombuffer(bytes(self.held), self.kind)
            rows = -(-len(ids) // self.length)
            self._batch(np.concatenate([ids, np.zeros(rows * self.length - len(ids), self.kind)]), len(ids))
        self.out.close()


def write_sequences(docs: DataFrame, folder: str, tokenizer: str, end_id: int, length: int = 1024, per_batch: int = 256, partitions: int | None = None, words_held: int = 400_000, words_kept: int = 50_000) -> list:
    """Writes the files; returns a row (part, path, n_docs, n_tokens) for each, in stream order.

    words_held, words_kept: words whose ids a worker remembers during a task and from one to the next, some 170 bytes each.

    A task writes under a name of its own attempt and renames at its end, so a repeated task leaves one whole file."""
    spark = docs.sparkSession
    common.small_batches(spark)
    fs, at = common.file_system(folder)
    fs.create_dir(at, recursive=True)
    ties = [F.coalesce(F.octet_length("text"), F.lit(0)), F.xxhash64("text")]
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.repartitionByRange(partitions or common.partitions_for(docs), "doc_id", *ties).sortWithinPartitions("doc_id", *ties, "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = common.file_system(folder)
        context = TaskContext.get()
        part = context.partitionId()
        name, own = f"{at}/part-{part:06d}", f".{context.taskAttemptId()}.tmp"
        words, writer, sink, starts = coder(tokenizer, words_held), None, None, []
        end = np.array([end_id], words.kind).tobytes()
        for batch in batches:
            if not len(batch):
                continue
            if writer is None:
                sink = fs.open_output_stream(f"{name}.arrow{own}")
                writer = _Writer(sink, words.kind, length, per_batch)
            text, offsets = common.text_bytes(batch.column(1))
            first = np.empty(len(batch), np.int64)
            for a, b in common.slices(offsets, _SLICE):
                for i, ids in enumerate(words.encode([text[offsets[i] : offsets[i + 1]].tobytes() for i in range(a, b)]), a):
                    first[i] = writer.n
                    writer.add(ids + end)
            starts.append(pa.record_batch([batch.column(0), pa.array(first), pa.array(np.diff(np.append(first, writer.n)))], names=["doc_id", "first", "n_tokens"]))
        words.trim(words_kept)
        if writer is not None:
            writer.close()
            sink.close()
            with fs.open_output_stream(f"{name}.index{own}") as sink, pa.ipc.new_file(sink, starts[0].schema) as out:
                for x in starts:
                    out.write_batch(x)
            for kind in ("index", "arrow"):
                fs.move(f"{name}.{kind}{own}", f"{name}.{kind}")
            yield pa.RecordBatch.from_pylist([{"part": part, "path": f"{folder}/part-{part:06d}", "n_docs": sum(map(len, starts)), "n_tokens": writer.n}], schema=pa.schema([("part", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    return sorted(ordered.mapInArrow(write, FILES).collect())


class SequenceFile:
    """Random access to one written file: sequences as views of the mapped file, and any run of its stream."""

    def __init__(self, path: str) -> None:
        fs, at = common.file_system(path)
        local = fs.type_name == "local"
        open_ = (lambda name: pa.memory_map(name)) if local else fs.open_input_file
        self.file = pa.ipc.open_file(open_(f"{at}.arrow"))
        self.index = pa.ipc.open_file(open_(f"{at}.index"))
        self.length = self.file.schema.field("ids").type.list_size
        self.size = self.file.get_batch(0).num_rows * self.length
        self.last = (-1, None)

    def ids(self, batch: int) -> np.ndarray:
        """The ids of a record batch as one array over the mapped file."""
        if self.last[0] != batch:
            self.last = batch, self.file.get_batch(batch).column(0).flatten().to_numpy()
        return self.last[1]

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        batch, row = divmod(i, self.size // self.length)
        return self.ids(batch)[row * self.length : (row + 1) * self.length], self.file.get_batch(batch).column(1)[row].values.to_numpy(zero_copy_only=False)

    def run(self, first: int, n: int) -> Iterator[np.ndarray]:
        while n > 0:
            batch, skip = divmod(first, self.size)
            piece = self.ids(batch)[skip : skip + n]
            yield piece
            first, n = first + len(piece), n - len(piece)


def read_documents(spark, files: list) -> DataFrame:
    """A row for each document, from the files alone: its start in the whole stream, its ids' number and CRC-32."""
    starts = np.cumsum([0, *(f.n_tokens for f in files)])
    listed = spark.createDataFrame([(f.path, int(s)) for f, s in zip(files, starts, strict=False)], "path string, start long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for listing in batches:
            for path, start in zip(listing.column(0).to_pylist(), listing.column(1).to_pylist(), strict=True):
                file = SequenceFile(path)
                for b in range(file.index.num_record_batches):
                    index, crcs = file.index.get_batch(b), []
                    for first, n in zip(index.column(1).to_pylist(), index.column(2).to_pylist(), strict=True):
                        crc = 0
                        for piece in file.run(first, n):
                            crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
                        crcs.append(crc)
                    yield pa.record_batch([index.column(0), pa.array(index.column(1).to_numpy() + start), index.column(2), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return listed.repartition(max(1, len(files))).mapInArrow(read, ROWS)


def encode_to_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, **options) -> DataFrame:
    """Writes the files to ``folder`` (a new one in the shared folder if None) and returns ``read_documents`` of them."""
    spark = docs.sparkSession
    return read_documents(spark, write_sequences(docs, folder or common.new_folder(spark, "sequences"), tokenizer, end_id, **options))
