"""Token ids in seekable binary files: independent zstandard frames, a trailing seek table, and a checksum of each frame.

A file is a row of zstandard frames, then one skippable frame that holds the seek table, so that any zstandard reader can also read it
from front to back. A frame holds whole documents: their number (4 bytes), a byte, an id and a number of tokens for each (the byte is 0 where
the id is null), then the tokens of all, little-endian, two bytes each where the vocabulary allows it, else four. A frame is closed at
``FRAME`` bytes of tokens; a longer document has one of its own. The seek table has a line for each frame (its size, its size decompressed, the
CRC-32 of what it decompresses to, its documents and tokens, the first and last id) and ends with the number of lines, the width of a token
and a magic number, in bytes of known number, so it is found from the end. Who wants some documents reads the end of the file, then those frames.

Rows are put in order of their ids by a range shuffle with a hash of the text and the row's own number behind the id, so equal ids and equal rows
don't make a task of their own size. Each task writes one file through ``pyarrow.fs`` (local folders, HDFS, object stores) under a
name of its own and returns the lines of its seek table. The lines that Spark commits are the manifest: a task that is lost or run
twice leaves a file that no manifest names. Tokens before a file are summed over one row a file.

Texts are cut before each space that no space follows, where every byte-level tokenizer without prefix space or normalizer cuts too; such a tokenizer's
pieces are looked up by each worker in a bounded table of pieces met before. Those of some texts that are not in it go to the tokenizer together: the tokens that
begin with a space tell where each begins. Other tokenizers get whole texts. Strings of special tokens in a text are ordinary text.

Defined results: a null text is empty and has the end token alone; null ids come first; rows with equal ids stay in the order of
a hash of their texts (equal rows are interchangeable); no rows give no files and an empty manifest. Extra columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import compress
from operator import not_

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.written import folder
from .common import materialize

END = 2
#: Bytes of tokens after which a frame is closed; pieces a worker keeps at the beginning of some texts.
FRAME, MOST_PIECES = 1 << 20, 1_000_000
#: Letters of a piece that is kept; letters of texts that are encoded together.
LONGEST, TOGETHER = 64, 1 << 20
#: A frame that zstandard readers skip, and this table's own mark.
SKIPPED, MAGIC = 0x184D2A5E, 0x4C4F4453
LINE, TAIL = struct.Struct("<QQIIQqqI"), struct.Struct("<IBI")
MANIFEST = "file string, part int, frame int, offset long, size long, raw long, crc long, docs long, tokens long, first_id long, last_id long"

CUT = re.compile(r" (?=\S)")


class Encoder:
    """Texts to the bytes of their tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            how = json.load(f)
        before = how.get("pre_tokenizer") or {}
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.type = np.dtype(f"<u{self.width}")
        self.by_word = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not how.get("normalizer")
        #: Tokens that begin with a space, as byte-level vocabularies write it.
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.spaced[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith("Ġ")]] = True
        self.pieces: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.type)

    def _raw(self, text: str) -> bytes:
        return self._ids(text).tobytes()

    def _learnt(self, pieces: list[str]) -> dict[str, bytes]:
        """The tokens of pieces that a space goes before."""
        plain = [p for p in pieces if " " not in p]
        ids = self._ids(" " + " ".join(plain)) if plain else np.zeros(0, self.type)
        edges = np.append(np.flatnonzero(self.spaced[ids]), len(ids))
        if len(edges) != len(plain) + 1:
            return {p: self._raw(" " + p) for p in pieces}
        raw, edges = ids.tobytes(), (edges * self.width).tolist()
        return {p: raw[a:b] for p, a, b in zip(plain, edges, edges[1:])} | {p: self._raw(" " + p) for p in pieces if " " in p}

    def encoded(self, texts: list[str]) -> list[bytes]:
        """The tokens of each of some texts, short ones together."""
        if not self.by_word:
            return [self._raw(x) for x in texts]
        if len(self.pieces) > MOST_PIECES:
            self.pieces.clear()
        cut, new, kept = [], set(), self.pieces.get
        for text in texts:
            pieces = text.split(" ")
            found = list(map(kept, pieces[1:]))
            missing = list(compress(pieces[1:], map(not_, found)))
            if any(not p or p[0].isspace() for p in missing):  # such pieces are never kept
                pieces = CUT.split(text)
                found = list(map(kept, pieces[1:]))
                missing = list(compress(pieces[1:], map(not_, found)))
            new.update(missing)
            cut.append((pieces, found))
        learnt = self._learnt(list(new))
        out = []
        for pieces, found in cut:
            for i in [i for i, x in enumerate(found) if x is None]:
                found[i] = learnt[pieces[i + 1]]
            out.append(self._raw(pieces[0]) + b"".join(found))
        self.pieces.update((p, x) for p, x in learnt.items() if len(p) <= LONGEST)
        return out

    def __call__(self, text: str) -> bytes:
        return self.encoded([text])[0]


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _encoded(encode: Encoder, texts: list[str]) -> Iterator[bytes]:
    """The tokens of each text, made for about ``TOGETHER`` letters at a time."""
    own, size = [], 0
    for x in texts:
        own.append(x)
        size += len(x)
        if size >= TOGETHER:
            yield from encode.encoded(own)
            own, size = [], 0
    yield from encode.encoded(own)


def _opened(uri: str):
    """A file system and a path in it, for a folder that executors and driver share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Writer:
    """Writes one file; ``lines`` has a line of the seek table for each frame."""

    def __init__(self, out, width: int, level: int = 3, frame: int = FRAME):
        self.out, self.width, self.frame, self.zstd = out, width, frame, zstandard.ZstdCompressor(level=level)
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.tokens: list[bytes] = []
        self.held = self.at = 0
        self.lines: list[tuple] = []

    def add(self, doc_id: int | None, tokens: bytes) -> None:
        if self.ids and self.held + len(tokens) > self.frame:
            self.close_frame()
        self.ids.append(doc_id)
        self.sizes.append(len(tokens) // self.width)
        self.tokens.append(tokens)
        self.held += len(tokens)

    def close_frame(self) -> None:
        known = np.array([i is not None for i in self.ids], np.uint8)
        ids = np.array([i or 0 for i in self.ids], "<i8")
        raw = b"".join([struct.pack("<I", len(ids)), known.tobytes(), ids.tobytes(), np.array(self.sizes, "<u4").tobytes(), *self.tokens])
        packed = self.zstd.compress(raw)
        self.out.write(packed)
        own = [i for i in self.ids if i is not None]
        self.lines.append((self.at, len(packed), len(raw), zlib.crc32(raw), len(ids), sum(self.sizes), min(own, default=0), max(own, default=0), len(own)))
        self.at += len(packed)
        self.ids, self.sizes, self.tokens, self.held = [], [], [], 0

    def close(self) -> None:
        if self.ids:
            self.close_frame()
        table = b"".join(LINE.pack(*x[1:]) for x in self.lines) + TAIL.pack(len(self.lines), self.width, MAGIC)
        self.out.write(struct.pack("<II", SKIPPED, len(table)) + table)


class Reader:
    """A file's documents, by frames; only frames that are asked for are read and decompressed."""

    def __init__(self, file):
        self.file = file
        file.seek(file.size() - TAIL.size)
        frames, self.width, magic = TAIL.unpack(file.read(TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a token file, or cut off")
        file.seek(file.size() - TAIL.size - frames * LINE.size)
        table = file.read(frames * LINE.size)
        self.lines, at = [], 0
        for line in LINE.iter_unpack(table):
            self.lines.append((at, *line))
            at += line[0]

    def frame(self, n: int) -> list[tuple[int | None, np.ndarray]]:
        """``(doc_id, tokens)`` of the frame's documents; an error if its checksum is another."""
        at, size, raw_size, crc, *_ = self.lines[n]
        self.file.seek(at)
        raw = zstandard.ZstdDecompressor().decompress(self.file.read(size), max_output_size=raw_size)
        if zlib.crc32(raw) != crc or len(raw) != raw_size:
            raise ValueError(f"frame {n}: checksum doesn't match")
        (docs,) = struct.unpack_from("<I", raw)
        known = np.frombuffer(raw, np.uint8, docs, 4)
        ids = np.frombuffer(raw, "<i8", docs, 4 + docs)
        ends = np.cumsum(np.frombuffer(raw, "<u4", docs, 4 + 9 * docs).astype(np.int64))
        tokens = np.frombuffer(raw, f"<u{self.width}", int(ends[-1]) if docs else 0, 4 + 13 * docs)
        return [(int(i) if k else None, tokens[e - n : e]) for i, k, e, n in zip(ids, known, ends, np.diff(ends, prepend=0), strict=True)]

    def documents(self, wanted: Iterable[int | None] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """All documents, or those of the ids ``wanted``, from the frames that may hold them."""
        if wanted is None:
            for n in range(len(self.lines)):
                yield from self.frame(n)
            return
        wanted = set(wanted)
        asked = np.array(sorted(i for i in wanted if i is not None), np.int64)
        for n, (*_, docs, _, first, last, known) in enumerate(self.lines):
            near = known and np.searchsorted(asked, first, "left") < np.searchsorted(asked, last, "right")
            if near or (None in wanted and known < docs):
                yield from ((i, t) for i, t in self.frame(n) if i in wanted)


def write(docs: DataFrame, tokenizer: str, path: str | None = None, text: str = "text", key: str = "doc_id", end: int | None = END) -> DataFrame:
    """Writes ``docs`` into files below ``path`` in ascending order of ``key`` (an integer) and returns the manifest, a row a frame.

    ``tokenizer`` is a file of the tokenizers library that every executor has. ``end`` is appended to each document.
    """
    path = path or f"{folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        last = b"" if end is None else np.array([end], encode.type).tobytes()
        out = writer = None
        for part in parts:
            if writer is None and len(part):
                system, at = _opened(path)
                system.create_dir(at, recursive=True)
                name = f"part-{uuid.uuid4().hex}.tokens"
                out = system.open_output_stream(f"{at}/{name}")
                writer = Writer(out, encode.width)
            for i, known, tokens in zip(part["id"].tolist(), part["known"].tolist(), _encoded(encode, part["text"].tolist()), strict=True):
                writer.add(i if known else None, tokens + last)
        if writer:
            writer.close()
            out.close()
            task = TaskContext.get().partitionId()
            rows = [(f"{path}/{name}", task, n, *line[:6], *((line[6], line[7]) if line[8] else (None, None))) for n, line in enumerate(writer.lines)]
            yield _table(rows, MANIFEST)

    id_ = F.col(key).cast("long")
    rows = docs.select(id_.alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text"), F.monotonically_increasing_id()]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"))
    rows = rows.select(F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNotNull().alias("known"), "text")
    return materialize(rows.mapInPandas(of, MANIFEST), "token-manifest")


def starts(manifest: DataFrame) -> DataFrame:
    """``file, start``: the tokens before each file. The window has one row a file."""
    sizes = manifest.groupBy("file", "part").agg(F.sum("tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.select("file", F.coalesce(before, F.lit(0)).alias("start"))


def _files(manifest: DataFrame) -> DataFrame:
    """A task for each file."""
    files = materialize(starts(manifest), "token-starts")
    return files.repartition(max(1, files.count()), "file")


def _frames(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[int, list[tuple[int | None, np.ndarray]]]]:
    """``start, documents`` of each frame of the files in ``parts``."""
    for part in parts:
        for name, start in zip(part["file"].tolist(), part["start"].tolist(), strict=True):
            system, at = _opened(name)
            with system.open_input_file(at) as file:
                reader = Reader(file)
                for n in range(len(reader.lines)):
                    yield start, reader.frame(n)
                    start += reader.lines[n][5]


def _table(rows: list[tuple], columns: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in columns.split(", ")], dtype=object)


def digests(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read from the files."""
    columns = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for start, docs in _frames(parts):
            rows = []
            for i, t in docs:
                rows.append((i, start, len(t), zlib.crc32(t.astype("<u4").tobytes())))
                start += len(t)
            yield _table(rows, columns)

    return _files(manifest).mapInPandas(of, columns)


def read(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, tokens`` of every document."""
    columns = "doc_id long, start long, tokens array<long>"

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for start, docs in _frames(parts):
            rows = []
            for i, t in docs:
                rows.append((i, start, t.tolist()))
                start += len(t)
            yield _table(rows, columns)

    return _files(manifest).mapInPandas(of, columns)


def lookup(manifest: DataFrame, wanted: DataFrame, key: str = "doc_id") -> DataFrame:
    """``doc_id, tokens`` of the documents whose ids stand in ``wanted``, from the frames that may hold them; null ids are not looked up.

    Each task takes a range of ids and reads the ends of the files that cover it, then those frames. The list of files, a row each, goes to every task.
    """
    files = manifest.groupBy("file").agg(F.min("first_id").alias("first"), F.max("last_id").alias("last")).where("first is not null").orderBy("first", "last").collect()
    first, last, names = [f["first"] for f in files], np.maximum.accumulate(np.array([f["last"] for f in files], np.int64)), [f["file"] for f in files]
    columns = "doc_id long, tokens array<long>"

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            ids = np.sort(part["id"].to_numpy(np.int64))
            for n in range(int(np.searchsorted(last, ids[0])) if len(ids) else len(names), len(names)):
                if first[n] > ids[-1]:
                    break
                own = ids[np.searchsorted(ids, first[n]) : np.searchsorted(ids, last[n], "right")]
                if len(own):
                    system, at = _opened(names[n])
                    with system.open_input_file(at) as file:
                        yield _table([(i, t.tolist()) for i, t in Reader(file).documents(own.tolist())], columns)

    asked = wanted.select(F.col(key).cast("long").alias("id")).dropna().distinct()
    return asked.repartitionByRange("id").mapInPandas(of, columns)
