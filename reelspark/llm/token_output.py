"""Token-ID output: flat unsigned integer files with 64-bit document offsets, to be memory-mapped.

A shard is three files: ``ids`` (flat unsigned integers, 16 bits if the vocabulary fits, else 32),
``offsets`` (64-bit: n + 1 positions in ids) and ``docs`` (64-bit document ids). Shards hold ranges
of document ids in ascending order. Each shard knows only its own positions; a shard's base in the
whole stream is the prefix sum of the sizes before it, kept in the manifest.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspark.llm._store import id_value, materialize, new_path, texts
from reelspark.llm._text import Bytes, blocks

END_ID = 0
#: Pieces whose ids a Python worker keeps, and the bytes of the longest kept one; others are encoded again each time they occur.
CACHE_PIECES = 1_000_000
CACHE_BYTES = 64

_U = np.uint64
_SLOT_BITS = 18
#: Bytes that begin a character other than white space, whatever follows them.
_OPENS = np.zeros(256, bool)
_OPENS[33:127] = True
_OPENS[[b for b in range(0xC3, 0xF5) if b not in (0xE1, 0xE2, 0xE3)]] = True


class Encoder:
    """Ids of texts, by way of pieces that begin with a space.

    Byte-level pre-tokenizers of this family begin a piece with the space that stands before a character
    other than white space, whatever is before it, so a text splits there, and each piece's ids don't
    depend on its neighbours. Pieces are told apart by 64-bit hashes, and their ids are kept. Texts with
    a token that the tokenizer takes out before it splits, and those of other tokenizers, are one piece.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.uint16 if size <= 1 << 16 else np.uint32
        self.splits = self._splits()
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[int, int] = {}  # hash of a piece: its number
        self.pool = np.zeros(1 << 16, self.dtype)  # the ids of all pieces
        self.begin, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)  # where a piece's ids are
        self.n_pieces = self.n_ids = 0
        # The piece last seen under some bits of its hash: most lookups end here.
        self.slot_hash, self.slot_piece = np.zeros(1 << _SLOT_BITS, _U), np.zeros(1 << _SLOT_BITS, np.int64)

    def _splits(self) -> bool:
        """Whether pieces may be encoded one by one: byte-level pieces and nothing that looks at the whole text."""
        import json

        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        return spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)

    def _ids(self, pieces: list[bytes], joined: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, how many each has). Joined: many in one text, as each begins where a piece
        begins in any text; its ids are told apart by their lengths in bytes."""
        ids, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if not joined:
            for e in self.tokenizer.encode_batch_fast([x.decode() for x in pieces], add_special_tokens=False):
                ids.append(np.array(e.ids, np.int64))
                sizes.append(np.array([len(e.ids)]))
        for a in range(0, len(pieces) if joined else 0, 4000):
            some = pieces[a : a + 4000]
            (e,) = self.tokenizer.encode_batch_fast([b"".join(some).decode()], add_special_tokens=False)
            ids.append(np.array(e.ids, np.int64))
            ends = np.cumsum(self._lengths()[ids[-1]])
            sizes.append(np.diff(np.searchsorted(ends, np.cumsum([0, *map(len, some)]), "right")))
        return np.concatenate(ids), np.concatenate(sizes)

    def _lengths(self) -> np.ndarray:
        if not hasattr(self, "_id_lengths"):
            vocab = self.tokenizer.get_vocab()
            self._id_lengths = np.zeros(max(vocab.values()) + 1, np.int64)
            for token, i in vocab.items():
                self._id_lengths[i] = len(token)  # byte-level tokens are spelt with one character a byte
        return self._id_lengths

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces begin."""
        begins = np.zeros(len(data) + 1, bool)
        if self.splits:
            begins[:-2] = (data[:-1] == 32) & _OPENS[data[1:]]
            raw = data.tobytes()
            for token in self.added:
                at = raw.find(token)
                while at >= 0:
                    row = int(np.searchsorted(offsets, at, "right")) - 1
                    begins[offsets[row] : offsets[row + 1]] = False
                    at = raw.find(token, max(at + 1, int(offsets[row + 1])))
            begins[np.maximum(offsets[1:] - 1, 0)] = False  # a space that ends its row
        begins[offsets[:-1]] = True
        begins[-1] = False
        return np.flatnonzero(begins)

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Numbers of new pieces."""
        n, m = self.n_pieces + len(sizes), self.n_ids + len(ids)
        if n > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.zeros(n, np.int64)]) for x in (self.begin, self.size))
        if m > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(m, self.dtype)])
        self.begin[self.n_pieces : n] = self.n_ids + np.cumsum(sizes) - sizes
        self.size[self.n_pieces : n] = sizes
        self.pool[self.n_ids : m] = ids
        number = np.arange(self.n_pieces, n)
        self.n_pieces, self.n_ids = n, m
        return number

    def _look_up(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number of each piece. Pieces that aren't kept stand after the kept ones till the next call."""
        slot = (hashes >> _U(64 - _SLOT_BITS)).astype(np.int64)
        piece = self.slot_piece[slot]
        miss = np.flatnonzero(self.slot_hash[slot] != hashes)
        if not len(miss):
            return piece
        own, first, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
        number = np.array([self.known.get(h, -1) for h in own.tolist()], np.int64)
        at = miss[first]
        new = np.flatnonzero(number < 0)
        a, b = begins[at[new]], ends[at[new]]
        short = np.flatnonzero(b - a <= CACHE_BYTES)[: max(0, CACHE_PIECES - self.n_pieces)]
        keep = np.zeros(len(new), bool)
        keep[short] = True
        raw = data.tobytes()
        joined = (b - a > 1) & (data[a] == 32) & _OPENS[data[np.minimum(a + 1, len(data) - 1)]] & self.splits
        if any(token in raw for token in self.added):
            joined &= np.array([not any(t in raw[x:y] for t in self.added) for x, y in zip(a.tolist(), b.tolist(), strict=True)], bool)
        n = m = 0
        for kept in (True, False):
            for way in (True, False):
                some = np.flatnonzero((keep == kept) & (joined == way))
                pieces = [raw[x:y] for x, y in zip(a[some].tolist(), b[some].tolist(), strict=True)]
                number[new[some]] = self._add(*self._ids(pieces, way))
            if kept:
                n, m = self.n_pieces, self.n_ids
        self.n_pieces, self.n_ids = n, m
        self.known.update(zip(own[new[keep]].tolist(), number[new[keep]].tolist(), strict=True))
        stays = np.ones(len(own), bool)
        stays[new[~keep]] = False
        self.slot_hash[slot[at[stays]]], self.slot_piece[slot[at[stays]]] = own[stays], number[stays]
        piece[miss] = number[back]
        return piece

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, where each row's begin, and the end) of a block of texts."""
        begins = self._cuts(data, offsets)
        ends = np.append(begins[1:], len(data))[: len(begins)]
        piece = self._look_up(data, begins, ends, Bytes(data).slices(begins, ends))
        sizes = self.size[piece]
        upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        ids = self.pool[np.repeat(self.begin[piece] - upto[:-1], sizes) + np.arange(upto[-1])]
        return ids, upto[np.searchsorted(begins, offsets)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker: it keeps the words it has seen."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


#: What the names of Spark's file systems are called here.
_SCHEMES = {"s3a://": "s3://", "s3n://": "s3://", "dbfs:/": "file:///dbfs/"}


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    for theirs, ours in _SCHEMES.items():
        if path.startswith(theirs):
            path = ours + path.removeprefix(theirs).lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path)


def _writer(base: str, tokenizer_path: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        coder = encoder(tokenizer_path)
        little = np.dtype(coder.dtype).newbyteorder("<")
        fs, root = _open(base)
        # A name of its own for each attempt: a repeated task never touches another's files.
        name = f"{shard:06d}-{uuid.uuid4().hex}"
        fs.create_dir(f"{root}/{name}", recursive=True)
        keys, ends, total, width = [], [np.zeros(1, np.int64)], 0, np.dtype(coder.dtype).itemsize
        with fs.open_output_stream(f"{root}/{name}/ids") as out:
            for batch in batches:
                keys.append(batch.column("key").to_numpy())
                for _, _, data, offsets in blocks(batch):
                    ids, cuts = coder.encode(data, offsets)
                    out.write(np.insert(ids, cuts[1:], end_id).astype(little).tobytes())
                    ends.append(total + cuts[1:] + np.arange(1, len(cuts)))
                    total = int(ends[-1][-1])
        n = sum(map(len, keys))
        with fs.open_output_stream(f"{root}/{name}/offsets") as out:
            out.write(np.concatenate(ends).astype("<i8").tobytes())
        with fs.open_output_stream(f"{root}/{name}/docs") as out:
            out.write(np.concatenate([*keys, np.zeros(0, np.int64)]).astype("<i8").tobytes())
        if n:
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [f"{base}/{name}"], "width": [width], "n_docs": [n], "n_tokens": [total]}, pa.schema([("shard", pa.int32()), ("path", pa.string()), ("width", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    return write


def write_tokens(docs: DataFrame, tokenizer_path: str, base: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Encodes and writes the texts in ascending id order; returns the manifest.

    Manifest: shard, path, width (bytes of an id), n_docs, n_tokens, base (ids before the shard),
    doc_base (documents before it). A null text is empty and has the end id alone; a null id comes
    first; rows with one id are ordered by a hash of their text, and may be dealt to several shards; an
    empty table has an empty manifest.
    """
    base = base or new_path(docs.sparkSession, "tokens")
    ordered = texts(docs, id_col, text_col).repartitionByRange("key", "body").sortWithinPartitions("key", "body")
    shards = materialize(ordered.mapInArrow(_writer(base, tokenizer_path, end_id), "shard int, path string, width int, n_docs long, n_tokens long"), "token-shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    return materialize(shards.select("*", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("n_docs").over(before), F.lit(0)).alias("doc_base")), "token-manifest")


class Shard:
    """A shard's arrays: memory-mapped where its files are local, else read by parts through the file system."""

    def __init__(self, path: str, width: int):
        self.path, self.dtype = path, np.dtype(f"<u{width}")
        self.offsets = self._array(f"{path}/offsets", np.dtype("<i8"))
        self.docs = self._array(f"{path}/docs", np.dtype("<i8"))
        fs, name = _open(f"{path}/ids")
        self.local = isinstance(fs, pyarrow.fs.LocalFileSystem)
        self.ids = self._array(f"{path}/ids", self.dtype) if self.local else None
        self.file = None if self.local else fs.open_input_file(name)

    @staticmethod
    def _array(path: str, dtype: np.dtype) -> np.ndarray:
        fs, name = _open(path)
        if isinstance(fs, pyarrow.fs.LocalFileSystem):
            return np.memmap(name, dtype, "r") if fs.get_file_info(name).size else np.zeros(0, dtype)
        with fs.open_input_file(name) as f:
            return np.frombuffer(f.read(), dtype)

    def span(self, first: int, last: int) -> np.ndarray:
        """The ids of documents from ``first`` up to ``last``."""
        a, b = int(self.offsets[first]), int(self.offsets[last])
        if self.local:
            return self.ids[a:b]
        width = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((b - a) * width, a * width), self.dtype)

    def document(self, i: int) -> np.ndarray:
        return self.span(i, i + 1)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            shard = Shard(row["path"], row["width"])
            for a in range(0, row["n_docs"], 1024):
                b = min(a + 1024, row["n_docs"])
                cuts = np.array(shard.offsets[a : b + 1])
                ids = memoryview(shard.span(a, b).astype("<u4").tobytes())
                at = ((cuts - cuts[0]) * 4).tolist()
                crc = [zlib.crc32(ids[x:y]) for x, y in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(shard.docs[a:b])), pa.array(row["base"] + cuts[:-1]), pa.array(np.diff(cuts)), pa.array(crc, pa.int64())], ["key", "start", "n_tokens", "ids_crc32"]
                )


def read_tokens(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row per document, read from the files: id, start in the whole stream, n_tokens, ids_crc32.

    Each written row has its row, repeated ones too; the least 64-bit number stands for a null id in
    the files and is null again here; an empty manifest gives an empty table.
    """
    n = max(1, manifest.count())
    spread = manifest.repartition(n, "shard")
    return spread.mapInArrow(_read, "key long, start long, n_tokens long, ids_crc32 long").select(id_value("key").alias(id_col), "start", "n_tokens", "ids_crc32")
