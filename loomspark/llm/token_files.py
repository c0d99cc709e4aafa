"""Token-id files: concatenated ids with Elias-Fano encoded document boundaries.

A file holds a range of keys: the ids of its documents one after the other, two or four bytes each, then two rising
sequences, where documents start and which keys they have. Of such a sequence of n values up to U the lowest
log2(U / n) bits of each are stored as they are, the rest as gaps in unary, so a value takes about 2 + log2(U / n) bits.
select(i), the place of the i-th one in the unary bits, gives value i: it begins at a sample and counts ones from there.
Readers seek what they need by the footer, so a file is read in parts.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import bound_batches, cut, parts, shared_dir
from loomspark.llm.warc import _filesystem

MAGIC = b"EFTOKENS"
#: Every so many ones of the unary bits have a sample.
SAMPLE = 256
#: Ids of a file at most, but for its last document; documents that a reader's task takes.
IDS_OF_A_FILE, DOCS_OF_A_READ = 1 << 28, 1 << 15
#: Words that a worker remembers with their ids, and the characters that such a word has at most.
KNOWN, LONGEST = 200_000, 32
#: Words of Latin letters that no normal form changes or joins, and marks that split off from them.
PLAIN, MARKS = "^[A-Za-zÀ-ÖØ-öø-ɏ]+$", tuple(".,;:!?")


def packed(values: np.ndarray, width: int) -> bytes:
    """Values of `width` bits each, one after the other, lowest bit first."""
    if not width or not len(values):
        return b""
    out = []
    for at in range(0, len(values), 1 << 16):  # eight values fill whole bytes
        bits = (values[at : at + (1 << 16), None].astype(np.uint64) >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        out.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes())
    return b"".join(out)


def unpacked(data: bytes, width: int, skip: int, count: int) -> np.ndarray:
    """`count` values of `width` bits, after `skip` bits."""
    if not width:
        return np.zeros(count, dtype=np.int64)
    bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8), bitorder="little")[skip : skip + count * width].reshape(count, width)
    return (bits.astype(np.int64) << np.arange(width, dtype=np.int64)).sum(axis=1)


class EliasFano:
    """A rising sequence of integers from 0 as (params, bytes), and its values [i, j) read through a function of byte ranges."""

    @staticmethod
    def encode(values: np.ndarray) -> tuple[dict, bytes]:
        n, most = len(values), int(values[-1]) if len(values) else 0
        low = max(0, (most // n).bit_length() - 1) if n else 0
        places = (values >> low) + np.arange(n, dtype=np.int64)
        high = int(places[-1]) + 1 if n else 0
        bits = np.zeros(high, dtype=np.uint8)
        bits[places] = 1
        width = max(1, high.bit_length())
        pieces = [packed(values & ((1 << low) - 1), low), np.packbits(bits, bitorder="little").tobytes(), packed(places[::SAMPLE], width)]
        return {"n": n, "low": low, "width": width, "bytes": [len(p) for p in pieces]}, b"".join(pieces)

    @staticmethod
    def select(params: dict, read, i: int, j: int) -> np.ndarray:
        """Places of the i-th to (j-1)-th one of the unary bits."""
        low_bytes, high_bytes, _ = params["bytes"]
        sample, width = i // SAMPLE, params["width"]
        at = sample * width
        first = int(unpacked(read(low_bytes + high_bytes + at // 8, (at % 8 + width + 7) // 8), width, at % 8, 1)[0])
        skip, start, out, have, byte = i - sample * SAMPLE, first, [], 0, first // 8
        while have < skip + j - i:
            size = min(max(64, (skip + j - i - have) // 2), high_bytes - byte)
            bits = np.unpackbits(np.frombuffer(read(low_bytes + byte, size), dtype=np.uint8), bitorder="little")
            ones = np.flatnonzero(bits) + byte * 8
            ones = ones[ones >= start]
            out.append(ones)
            have, byte = have + len(ones), byte + size
        return np.concatenate(out)[skip : skip + j - i]

    @staticmethod
    def values(params: dict, read, i: int, j: int) -> np.ndarray:
        if j <= i:
            return np.empty(0, dtype=np.int64)
        places, low = EliasFano.select(params, read, i, j), params["low"]
        at = i * low
        rest = unpacked(read(at // 8, (at % 8 + (j - i) * low + 7) // 8), low, at % 8, j - i)
        return ((places - np.arange(i, j)) << low) | rest


class Encoder:
    """Ids of texts by a tokenizer file whose pre-tokenizer keeps nothing across spaces and line feeds.

    A text's ids are then those of its words one after the other, and a word is encoded once for as long as it is
    remembered; what was not met among the last KNOWN to twice as many is forgotten. fits() says whether a tokenizer is
    of that kind; others get whole texts.
    """

    def __init__(self, path: str, dtype: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype, self.words, self.older = Tokenizer.from_file(path), dtype, {}, {}
        self.apart, self.ends = self.fits(path), None
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if suffix:
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.ends[[i for w, i in vocabulary.items() if w.endswith(suffix)]] = True
        self.marks = self._raw(list(MARKS))

    @staticmethod
    def fits(path: str) -> bool:
        """Whether words can be encoded apart: the split removes white space, and nothing is added to a text's start."""
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        steps = lambda x, many: [] if x is None else x.get(many, [x])
        before, split = steps(spec["normalizer"], "normalizers"), steps(spec["pre_tokenizer"], "pretokenizers")
        removes = lambda s: s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"] and "Regex" in s["pattern"] and not any(x in s["pattern"]["Regex"].replace(r"[^\s", "") for x in (r"\s", " ", ".", "(?"))
        plain = all(s["type"] in ("NFC", "Lowercase") or s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} and s["content"] == " " for s in before)
        added = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not set(t["content"]) & {" ", "\n"} for t in spec["added_tokens"])
        return bool(split) and removes(split[0]) and plain and added and all(s["type"] == "ByteLevel" and not s["add_prefix_space"] and not s["use_regex"] for s in split[1:])

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: pa.Array) -> list[bytes]:
        """The ids of each word. Words of plain letters are encoded as one text, in which each ends with an id of a word's end."""
        out: list[bytes | None] = [None] * len(words)
        plain = np.flatnonzero(pc.match_substring_regex(words, PLAIN).to_numpy(zero_copy_only=False)) if self.ends is not None else []
        for at in range(0, len(plain), 4096):
            some = plain[at : at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(words.take(pa.array(some)).to_pylist())], add_special_tokens=False)[0].ids, dtype=self.dtype)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some):
                data, stops = ids.tobytes(), (stops * ids.itemsize).tolist()
                for i, a, b in zip(some.tolist(), [0, *stops[:-1]], stops, strict=True):
                    out[i] = data[a:b]
        rest = [i for i, data in enumerate(out) if data is None]
        for i, data in zip(rest, self._raw(words.take(pa.array(rest, type=pa.int64())).to_pylist()), strict=True):
            out[i] = data
        return out

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text as bytes.

        Of a batch's words only the distinct ones are looked up, without what splits off or makes no difference: the last
        mark after a plain letter, and capitals of words in ASCII without a sign that special tokens have.
        """
        if not self.apart:
            for text in texts.to_pylist():
                yield self._raw([text])[0]
            return
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        bounds, met = split.offsets.to_numpy(), split.values.dictionary_encode()
        words = met.dictionary
        mark = pc.match_substring_regex(words, f"{PLAIN[1:-2]}[.,;:!?]$")
        base = pc.if_else(mark, pc.utf8_slice_codeunits(words, 0, -1), words)
        small = pc.and_(pc.string_is_ascii(base), pc.invert(pc.match_substring(base, "<")))
        forms = pc.if_else(small, pc.ascii_lower(base), base).dictionary_encode()
        if len(self.words) > KNOWN:
            self.older, self.words = self.words, {}
        names = forms.dictionary.to_pylist()
        found = [a if (a := self.words.get(w)) is not None else self.older.get(w) for w in names]
        new = [i for i, data in enumerate(found) if data is None]
        for i, data in zip(new, self._words(forms.dictionary.take(pa.array(new, type=pa.int64()))), strict=True):
            found[i] = data
        self.words.update((w, data) for w, data in zip(names, found, strict=True) if len(w) <= LONGEST)
        # each distinct word is its form and the mark after it, or nothing
        found += [*self.marks, b""]
        which = pc.index_in(pc.if_else(mark, pc.utf8_slice_codeunits(words, -1), ""), pa.array(MARKS, type=pa.large_string())).fill_null(len(MARKS))
        pair = np.stack([forms.indices.to_numpy(), which.to_numpy() + len(names)], axis=1)
        size = np.dtype(self.dtype).itemsize
        flat, ends = np.frombuffer(b"".join(found), dtype=self.dtype), np.cumsum([0, *(len(data) // size for data in found)], dtype=np.int32)
        flat, ends = _joined(flat, ends, pair.ravel())
        ids, ends = _joined(flat, ends[::2], met.indices.to_numpy(zero_copy_only=False))
        stops = ends[bounds - bounds[0]].tolist()
        for a, b in zip(stops[:-1], stops[1:], strict=True):
            yield ids[a:b].tobytes()


def _joined(flat: np.ndarray, ends: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of units one after the other, and their bounds; unit u is flat[ends[u]:ends[u + 1]]."""
    start = ends[units]
    n = ends[units + 1] - start
    out = np.zeros(len(units) + 1, dtype=np.int64)
    np.cumsum(n, out=out[1:])
    at = np.arange(out[-1], dtype=np.int32 if out[-1] < 1 << 31 else np.int64)
    at += np.repeat((start - out[:-1]).astype(at.dtype), n)
    return flat[at], out


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, dtype: str) -> Encoder:
    """A worker's encoder, kept for its later tasks."""
    if (path, dtype) not in _ENCODERS:
        _ENCODERS[path, dtype] = Encoder(path, dtype)
    return _ENCODERS[path, dtype]


class _Writer:
    """A file being written: ids go out as they come, boundaries and keys at its end."""

    def __init__(self, folder: str, dtype: str) -> None:
        fs, top = _filesystem(folder)
        fs.create_dir(top, recursive=True)
        name = f"ids-{uuid.uuid4().hex}.ef"
        self.file, self.out, self.dtype = f"{folder}/{name}", fs.open_output_stream(f"{top}/{name}", compression=None), np.dtype(dtype)
        self.keys, self.ends, self.ids, self.null = [], [0], 0, 0

    def add(self, key: int | None, data: bytes) -> None:
        self.out.write(data)
        self.ids += len(data) // self.dtype.itemsize
        self.ends.append(self.ids)
        if key is None:
            self.null += 1
        else:
            self.keys.append(key)

    def close(self) -> tuple[str, int, int]:
        keys = np.array(self.keys, dtype=np.int64)
        first = int(keys[0]) if len(keys) else 0
        starts, start_bytes = EliasFano.encode(np.array(self.ends, dtype=np.int64))
        names, name_bytes = EliasFano.encode(keys - first)
        footer = json.dumps({"dtype": self.dtype.str, "ids": self.ids, "null_keys": self.null, "first_key": first, "starts": starts, "keys": names}).encode()
        self.out.write(start_bytes + name_bytes + footer + struct.pack("<Q", len(footer)) + MAGIC)
        self.out.close()
        return self.file, len(self.ends) - 1, self.ids


class TokenFile:
    """Documents of a file, by their place in it."""

    def __init__(self, name: str) -> None:
        fs, path = _filesystem(name)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self._read(size - 16, 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{name} is no file of token ids")
        length = struct.unpack("<Q", tail[:8])[0]
        self.meta = json.loads(self._read(size - 16 - length, length))
        self.dtype = np.dtype(self.meta["dtype"])
        self.starts_at = self.meta["ids"] * self.dtype.itemsize
        self.keys_at = self.starts_at + sum(self.meta["starts"]["bytes"])

    def __enter__(self) -> TokenFile:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    @property
    def docs(self) -> int:
        return self.meta["starts"]["n"] - 1

    def bounds(self, i: int, j: int) -> np.ndarray:
        """Where documents i to j-1 start, and where the last of them ends."""
        return EliasFano.values(self.meta["starts"], lambda at, size: self._read(self.starts_at + at, size), i, j + 1)

    def keys(self, i: int, j: int) -> list[int | None]:
        null = self.meta["null_keys"]
        found = EliasFano.values(self.meta["keys"], lambda at, size: self._read(self.keys_at + at, size), max(i - null, 0), max(j - null, 0))
        return [None] * max(0, min(j, null) - i) + (found + self.meta["first_key"]).tolist()

    def ids(self, start: int, end: int) -> np.ndarray:
        return np.frombuffer(self._read(start * self.dtype.itemsize, (end - start) * self.dtype.itemsize), dtype=self.dtype)


def scratch(spark: SparkSession) -> str:
    """A new folder for files of ids in the shared folder; who asks for it deletes it when the rows are no longer read."""
    return f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = 2, key: str = "doc_id", text: Column | str = "text") -> DataFrame:
    """Writes the ids of all texts, in ascending order of key, to files in folder; returns (file, place, docs, ids, first).

    tokenizer is the path of a file of the tokenizers library that every executor has; end_id ends each document where it
    is given. Null texts are empty; null keys come first; rows with equal keys follow in the order of a hash of their
    texts. place orders the files, first counts the ids before a file. Keys are integral. Other columns are not read. An
    empty table gives no file. Files that a lost task left behind are named by nothing.

    Rows are dealt by ranges of key, text hash and row, so rows of one key may lie in several files.
    """
    bound_batches(docs.sparkSession)
    with open(tokenizer, encoding="utf-8") as file:
        spec = json.load(file)
    most = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"]), end_id or 0])
    dtype = "<u2" if most < 1 << 16 else "<u4"
    end = b"" if end_id is None else np.array([end_id], dtype=dtype).tobytes()

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, writer, own = TaskContext.get().partitionId(), 0, None, encoder(tokenizer, dtype)
        done = lambda w, n: pa.RecordBatch.from_pydict(dict(zip(("file", "place", "docs", "ids"), ([x] for x in (w.file, (part << 24) + n, *w.close()[1:])), strict=True)))
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), own.encode(batch.column(1)), strict=True):
                if writer and writer.ids >= IDS_OF_A_FILE:
                    yield done(writer, n)
                    writer, n = None, n + 1
                writer = writer or _Writer(folder, dtype)
                writer.add(k, data + end)
        if writer:
            yield done(writer, n)

    body = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("k"), body.alias("t")).withColumns({"h": F.xxhash64("t"), "r": F.monotonically_increasing_id()})
    dealt = rows.repartitionByRange(parts(docs.sparkSession), "k", "h", "r").sortWithinPartitions("k", "h", "r").select("k", "t")
    files = cut(dealt.mapInArrow(store, "file string, place long, docs long, ids long"))
    before, total = [], 0
    for row in files.orderBy("place").select("place", "ids").toLocalIterator():  # a row for each file
        before.append((row["place"], total))
        total += row["ids"]
    return files.join(F.broadcast(files.sparkSession.createDataFrame(before, "place long, first long")), "place")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray, int]]:
    """Keys, bounds in the file, ids and ids before the file, of about a million ids at a time, of the blocks (file, i, j, first)."""
    for batch in batches:
        for name, i, j, first in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            with TokenFile(name) as file:
                bounds, keys, at = file.bounds(i, j), file.keys(i, j), 0
                while at < j - i:
                    to = at + max(1, int(np.searchsorted(bounds[at + 1 :], bounds[at] + (1 << 20), side="right")))
                    yield keys[at:to], bounds[at : to + 1], file.ids(int(bounds[at]), int(bounds[to])), first
                    at = to


def _blocks(files: DataFrame, docs_of_a_read: int) -> DataFrame:
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("docs") - 1, F.lit(0)), F.lit(docs_of_a_read).cast("long")))
    blocks = files.select("file", begin.alias("i"), "docs", "first").select("file", "i", F.least(F.col("i") + docs_of_a_read, "docs").alias("j"), "first")
    return blocks.repartition(min(max(1, blocks.count()), 100_000))


def read(files: DataFrame, docs_of_a_read: int = DOCS_OF_A_READ) -> DataFrame:
    """The documents of files (file, docs, first): (key, start, ids), start counting ids before them in all files.

    A task takes docs_of_a_read documents of a file: it looks up their boundaries and keys and reads nothing else.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, bounds, ids, first in _documents(batches):
            lists = pa.ListArray.from_arrays(pa.array((bounds - bounds[0]).astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, type=pa.int64()), pa.array(bounds[:-1] + first, type=pa.int64()), lists], names=["key", "start", "ids"])

    return _blocks(files, docs_of_a_read).mapInArrow(scan, "key long, start long, ids array<int>")


def digests(files: DataFrame, docs_of_a_read: int = DOCS_OF_A_READ) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of the documents that read() gives, where they are read; the CRC is over little-endian 32-bit ids."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, bounds, ids, first in _documents(batches):
            wide, own = ids.astype("<u4"), (bounds - bounds[0]).tolist()
            sums = [zlib.crc32(wide[a:b]) for a, b in zip(own[:-1], own[1:], strict=True)]
            columns = [pa.array(keys, type=pa.int64()), pa.array(bounds[:-1] + first, type=pa.int64()), pa.array(np.diff(bounds), type=pa.int64()), pa.array(sums, type=pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "start", "n_tokens", "ids_crc32"])

    return _blocks(files, docs_of_a_read).mapInArrow(scan, "key long, start long, n_tokens long, ids_crc32 long")
