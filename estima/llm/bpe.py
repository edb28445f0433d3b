"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the bytes cuts each text where the last 32 bytes say so, so that passages shared by documents
are cut alike. A chunk is encoded once and its ids are kept, for all later documents of the worker, in a store of
bounded size. Encoding chunk by chunk is wrong only around the joins: there the pieces that the tokenizer's pattern
makes can differ. Each join is repaired: the last pieces of the left side and the first of the right side are
encoded together, in a window that is widened until its pieces agree with the chunk's own pieces again. The pattern
scans from left to right and looks one character ahead, so from a common boundary on both go on alike.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from estima.llm.common import row_chunks

#: Fixed value: the pattern that splits text into the pieces that byte-level BPE encodes one by one.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

CUT_BITS = 10  # a cut every 1024 bytes on average
LEAST, MOST = 256, 1 << 14  # bytes of a chunk; a longer one is cut by force
STORE_BYTES = 64 << 20  # of the chunks and ids that a worker keeps


@functools.cache
def _byte_of_symbol() -> dict[str, int]:
    """The vocabulary's characters for bytes: printable Latin-1 stands for itself, the others for 256, 257, ... in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """A byte-level BPE vocabulary in the tokenizers library's JSON format."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbol = _byte_of_symbol()
        vocab = spec["model"]["vocab"]
        ranks = {bytes(symbol[c] for c in token): i for token, i in vocab.items()}
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        merged = [vocab[a + b] for a, b in merges]
        if spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec["normalizer"] or merged != sorted(merged):
            raise ValueError("byte-level BPE without normalizer or prefix space is expected, with ids in the order of the merges")
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pieces = regex.compile(PIECES)
        self._encoding = tiktoken.Encoding("chunks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

    def plain(self, text: str) -> list[int]:
        return self._encoding.encode_ordinary(text)

    def decode(self, ids) -> str:
        """Bytes that are no UTF-8 become U+FFFD."""
        get = self.bytes_of
        return b"".join([get[i] for i in ids]).decode("utf-8", "replace")


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


_GEAR = np.frombuffer(hashlib.shake_128(b"chunk cuts").digest(4 * 256), "<u4")


def cut_points(data: np.ndarray) -> np.ndarray:
    """Ends of chunks in UTF-8 bytes, the last one len(data): where the hash of the last 32 bytes has CUT_BITS zeros."""
    n = len(data)
    if n <= LEAST:
        return np.array([n]) if n else np.empty(0, np.int64)
    h = _GEAR[data]  # h[i] = sum of gear[data[i - j]] << j over j < 32, by doubling the width
    for w in (1, 2, 4, 8, 16):
        h[w:] += h[:-w] << np.uint32(w)
    starts = (data & 0xC0) != 0x80  # no cut within a character
    at = np.flatnonzero((h[:-1] >> np.uint32(32 - CUT_BITS) == 0) & starts[1:]) + 1
    out, last = [], 0
    for a in [*at.tolist(), n]:
        while a - last > MOST:
            b = last + MOST
            while not starts[b]:
                b -= 1
            out.append(b)
            last = b
        if a - last >= LEAST or a == n:
            out.append(a)
            last = a
    return np.array(out)


class Chunk:
    """An encoded chunk: its text and ids and, as far as a repair has asked for them, its first and last pieces."""

    __slots__ = ("ids", "text", "_head", "_tail")

    def __init__(self, text: str, ids: np.ndarray):
        self.text, self.ids = text, ids
        self._head: dict[int, list[tuple[int, int]]] = {}
        self._tail: tuple[int, int] | None = None

    def head(self, c: Codec, chars: int) -> list[tuple[int, int]]:
        """(end in characters, end in ids) of the pieces that start within the first chars."""
        if chars not in self._head:
            out, ids = [], 0
            for m in c.pieces.finditer(self.text):
                if m.start() >= chars:
                    break
                ids += len(c.plain(m[0]))
                out.append((m.end(), ids))
            self._head[chars] = out
        return self._head[chars]


class ChunkStore:
    """Least recently used chunks go once the store holds more than STORE_BYTES."""

    def __init__(self, c: Codec, most: int = STORE_BYTES):
        self.codec, self.most, self.held = c, most, 0
        self.chunks: OrderedDict[bytes, Chunk] = OrderedDict()
        self.encoded = self.reused = 0

    def get(self, raw: bytes) -> Chunk:
        found = self.chunks.get(raw)
        if found is not None:
            self.reused += 1
            self.chunks.move_to_end(raw)
            return found
        self.encoded += 1
        text = raw.decode()
        found = self.chunks[raw] = Chunk(text, np.array(self.codec.plain(text), np.uint32))
        self.held += 3 * len(raw) + 600
        while self.held > self.most and len(self.chunks) > 1:
            old, _ = self.chunks.popitem(last=False)
            self.held -= 3 * len(old) + 600
        return found

    def encode(self, text: str) -> np.ndarray:
        """The ids of text, special tokens' strings included, as of the tokenizer over the whole text."""
        c = self.codec
        if c.special_pattern is None or not (marks := list(c.special_pattern.finditer(text))):
            return self._encode(text)
        out, at = [], 0
        for m in marks:
            out += [self._encode(text[at : m.start()]), np.array([c.special[m[0]]], np.uint32)]
            at = m.end()
        return np.concatenate([*out, self._encode(text[at:])])

    def _encode(self, text: str) -> np.ndarray:
        raw = text.encode()
        chunks, last = [], 0
        for end in cut_points(np.frombuffer(raw, np.uint8)).tolist():
            chunks.append(self.get(raw[last:end]))
            last = end
        if not chunks:
            return np.empty(0, np.uint32)
        if len(chunks) == 1:
            return chunks[0].ids
        return self._joined(chunks)

    def _joined(self, chunks: list[Chunk]) -> np.ndarray:
        """The chunks' ids, each join repaired. Invariant: out are the true ids of all text before `open_`, which starts
        at a true boundary of the pattern; its pieces aren't final, for the text to their right may change them."""
        c, out = self.codec, []
        open_ = ""
        for k, chunk in enumerate(chunks):
            final = k == len(chunks) - 1
            begin, begin_ids = 0, 0  # of what of the chunk's own ids is right
            if open_:
                at = self._agreement(open_, chunk)
                if at is None:  # no boundary in common: the whole chunk is taken into the window
                    open_ += chunk.text
                    if final:
                        out.append(np.array(c.plain(open_), np.uint32))
                    continue
                begin, begin_ids, window = at
                out.append(np.array(window, np.uint32))
            if final:
                out.append(chunk.ids[begin_ids:])
                continue
            cut, cut_ids = self._stable_end(chunk)
            if cut <= begin:
                open_ = chunk.text[begin:]
            else:
                out.append(chunk.ids[begin_ids:cut_ids])
                open_ = chunk.text[cut:]
        return np.concatenate(out)

    def _agreement(self, open_: str, chunk: Chunk) -> tuple[int, int, list[int]] | None:
        """The first place in chunk where the pattern's scan of open_ + chunk has a boundary that its scan of chunk alone
        has too, in characters and ids, and the window's ids up to there."""
        c, n, chars = self.codec, len(open_), 32
        while True:
            window = open_ + chunk.text[: 2 * chars]
            own = dict(chunk.head(c, chars))
            own[0] = 0
            whole = len(chunk.text) <= 2 * chars
            ends = [m.end() for m in c.pieces.finditer(window)]
            for end in ends:
                # a piece that touches the window's end, or white space before it, isn't final
                if end >= n and end - n in own and (end < len(window) - 1 and not window[end:].isspace()):
                    return end - n, own[end - n], c.plain(window[:end]) if self._same(window, end) else self._by_piece(window, end)
            if whole:
                return None
            chars *= 4

    def _same(self, window: str, end: int) -> bool:
        """Whether window[:end] alone is split as within window; white space before a word is not."""
        return not window[end - 1].isspace()

    def _by_piece(self, window: str, end: int) -> list[int]:
        out: list[int] = []
        for m in self.codec.pieces.finditer(window):
            if m.end() > end:
                break
            out += self.codec.plain(m[0])
        return out

    def _stable_end(self, chunk: Chunk) -> tuple[int, int]:
        """The start of the chunk's last pieces, which what follows may change, in characters and ids."""
        if chunk._tail is None:
            text, c, span = chunk.text, self.codec, 48
            while True:
                # a letter before a space and a letter is always a boundary: the tail's pieces can be told from there
                start = next((m.start() for m in regex.finditer(r"(?<=\p{L}) (?=\p{L})", text, pos=max(0, len(text) - span))), None)
                if start is not None and (m := c.pieces.match(text, start)) and m.end() < len(text) - 1:
                    break
                if span >= len(text):
                    start = 0
                    break
                span *= 4
            tail = sum(len(c.plain(m[0])) for m in c.pieces.finditer(text, start)) if start else len(chunk.ids)
            chunk._tail = (start, len(chunk.ids) - tail)
        return chunk._tail


def encode_documents(docs: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """docs with a column of token ids, array<int>; all other columns stay.

    path: the tokenizer's JSON file, at the same place on each worker. A null text counts as empty and has no ids; texts
    are encoded whole, however long; repeated rows are encoded alike.
    """
    docs = docs.drop(ids)  # if there is one
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = ChunkStore(codec(path))
        for part in row_chunks(batches):
            found = [store.encode(t) if t else np.empty(0, np.uint32) for t in part.column(part.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, _lists(found)], names=[*part.schema.names, ids])

    return docs.mapInArrow(encode, schema)


def decode_documents(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """encoded with a column of the text that the ids stand for, special tokens included; it replaces one of that name. Null ids give an empty text."""
    encoded = encoded.drop(out)
    schema = T.StructType([*encoded.schema.fields, T.StructField(out, T.StringType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [c.decode(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else "" for x in part.column(part.schema.get_field_index(ids))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, out])

    return encoded.mapInArrow(decode, schema)


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*found, np.empty(0, np.uint32)]).astype(np.int32)))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of encode_documents() and decode_documents() made where
    the ids are, so that neither ids nor texts go back to the JVM."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        store = ChunkStore(c)
        for part in row_chunks(batches):
            ids = [store.encode(t) if t else np.empty(0, np.uint32) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(c.decode(x.tolist()).encode()).hexdigest() for x in ids]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
