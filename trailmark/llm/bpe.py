"""Byte-level BPE encoding and decoding.

A segment tree stands over the ranks of adjacent symbol pairs.  A leaf holds ``rank * width + position`` (or infinity
if the pair cannot merge) and an inner node the least of its two children, so the root is the leftmost pair of the
lowest rank.  A merge changes three leaves and the nodes above them.  Short pieces run side by side, one tree to a row
of a matrix; long ones have a tree each.

Defined results: a null text counts as empty (no ids); special tokens written out in a text become their own id, as the
tokenizer file asks; columns other than the id column are not read, so clashing names do no harm; repeated rows give
repeated rows; an empty table gives an empty table.
"""

from __future__ import annotations

import itertools
import json
import re
import sys
import unicodedata
from array import array
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import map_text

#: Pieces of up to so many bytes are merged in matrix rows.
SHORT = 64
#: Bytes of pieces and ids that a task remembers; beyond that it starts anew.
REMEMBERED_BYTES = 24_000_000
FAR = np.int64(1) << 60


@lru_cache(maxsize=1)
def _classes() -> tuple[str, str]:
    """Bodies of regular-expression classes: all letters, all numbers."""

    def ranges(kind: str) -> str:
        found, start = [], None
        for c in range(sys.maxunicode + 2):
            inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == kind
            if inside and start is None:
                start = c
            elif not inside and start is not None:
                found.append(f"\\U{start:08x}-\\U{c - 1:08x}")
                start = None
        return "".join(found)

    return ranges("L"), ranges("N")


#: White space as the pre-tokenizer sees it: Python's also counts U+001C to U+001F.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


class Pieces:
    """Cuts a text into pieces: contractions, letters, numbers, other signs, each with a space before, and white space.

    Python's own classes agree with the pre-tokenizer's unless a text has number letters, U+001C to U+001F or characters
    beyond U+FFFF; only then
    the slower pattern with the classes spelt out is used.
    """

    def __init__(self):
        letter, number = _classes()
        odd = "".join(f"\\u{c:04x}" for c in range(0x10000) if unicodedata.category(chr(c)) in ("Nl", "No") or chr(c).isnumeric() and not chr(c).isdecimal())
        self.odd = re.compile(f"[\\x1c-\\x1f{odd}\\U00010000-\\U0010ffff]").search
        contracted = "'(?:s|t|re|ve|m|ll|d)"
        self.usual = re.compile(rf"{contracted}| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
        self.exact = re.compile(f"{contracted}| ?[{letter}]+| ?[{number}]+| ?[^{SPACE}{letter}{number}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall

    def __call__(self, text: str) -> list[str]:
        return self.exact(text) if self.odd(text) else self.usual(text)


class Numbered(dict):
    """A number for each new key, in order."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where it shows in Latin-1, else the next free character from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, free = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in table:
            table[b], free = chr(free), free + 1
    return [table[b] for b in range(256)]


class Codec:
    """A byte-level BPE vocabulary as arrays, with the segment-tree merger."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        symbols = byte_symbols()
        to_byte = {s: b for b, s in enumerate(symbols)}
        self.byte_id = np.array([vocab[s] for s in symbols], np.int64)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.table = [b""] * (1 + max([*vocab.values(), *special.values()]))
        for s, i in vocab.items():
            if s not in special:
                self.table[i] = bytes(to_byte[c] for c in s)
        for s, i in special.items():
            self.table[i] = s.encode()
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        pairs = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks = np.append(pairs[order], FAR), np.append(order, 0)
        self.sorted_pairs = memoryview(self.pairs)
        self.special = special
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.pieces = Pieces()
        self.forget()

    def forget(self) -> None:
        """Lets go of the pieces that were merged so far."""
        self.known, self.kept_bytes = Numbered(), 0
        self.pool = np.empty(1 << 20, np.uint32)
        self.start = np.zeros(1 << 18, np.int64)  # piece k has the ids pool[start[k]:start[k + 1]]

    # -- merging ---------------------------------------------------------------------------------------------------

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs, FAR where they cannot merge (a or b negative: no symbol)."""
        key = (a << 20) | b
        at = np.searchsorted(self.pairs, key)
        return np.where((self.pairs[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], FAR)

    def merge_rows(self, words: list[bytes]) -> list[np.ndarray]:
        """Merges many short pieces, a segment tree to each row."""
        out: list[np.ndarray] = [None] * len(words)  # type: ignore[list-item]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        width = 1
        low = 0
        while low < SHORT:
            high = width + 1  # pieces of low < n <= width + 1 symbols have at most ``width`` pairs
            group = np.flatnonzero((sizes > low) & (sizes <= high))
            if len(group):
                self._merge_group([words[i] for i in group], sizes[group], width, group, out)
            low, width = high, width * 2
        return out

    def _merge_group(self, words, sizes, width, group, out) -> None:
        n, cols = len(words), width + 3
        flat = np.frombuffer(b"".join(words), np.uint8)
        row = np.repeat(np.arange(n), sizes)
        col = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        ids = np.full((n, cols), -1, np.int64)
        ids[row, col] = self.byte_id[flat]
        after = np.tile(np.minimum(np.arange(1, cols + 1), cols - 1), (n, 1))
        before = np.tile(np.arange(-1, cols - 1), (n, 1))
        tree = np.full((n, 2 * width), FAR, np.int64)
        rank = self._rank(ids[:, :width], ids[:, 1 : width + 1])
        tree[:, width:] = np.where(rank < FAR, rank * width + np.arange(width), FAR)
        h = width // 2
        while h:
            tree[:, h : 2 * h] = np.minimum(tree[:, 2 * h : 4 * h : 2], tree[:, 2 * h + 1 : 4 * h : 2])
            h //= 2
        live = np.flatnonzero(tree[:, 1] < FAR)
        while len(live):
            root = tree[live, 1]
            p = root % width
            q = after[live, p]
            r = after[live, q]
            ids[live, p] = self.merged[root // width]
            ids[live, q] = -1
            after[live, p] = r
            before[live, r] = p
            o = before[live, p]
            self._set(tree, width, live, q, np.full(len(live), FAR))
            self._set(tree, width, live, p, self._rank(ids[live, p], ids[live, r]))
            self._set(tree, width, live, o, np.where(o >= 0, self._rank(ids[live, o], ids[live, p]), FAR))
            live = live[tree[live, 1] < FAR]
        keep = ids >= 0
        flat_ids, counts = ids[keep].astype(np.uint32), keep.sum(axis=1).tolist()
        at = 0
        for i, size in zip(group.tolist(), counts, strict=True):
            out[i] = flat_ids[at : at + size]
            at += size

    @staticmethod
    def _set(tree, width, rows, leaf, rank) -> None:
        """Point update of one leaf in each of ``rows`` and of the nodes above it; leaves outside the tree are skipped."""
        inside = (leaf >= 0) & (leaf < width)
        if not inside.all():
            rows, leaf, rank = rows[inside], leaf[inside], rank[inside]
        node = leaf + width
        tree[rows, node] = np.where(rank < FAR, rank * width + leaf, FAR)
        node = node >> 1
        while len(node) and node[0] >= 1:
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            node = node >> 1

    def merge_one(self, word: bytes) -> np.ndarray:
        """Merges one long piece with a segment tree of its own: O(n log n)."""
        first = self.byte_id[np.frombuffer(word, np.uint8)]
        ids = first.tolist()
        n, far = len(ids), int(FAR)
        width = 1
        while width < n:
            width *= 2
        ids.append(-1)
        after, before = array("q", range(1, n + 2)), array("q", range(-1, n))
        tree = array("q", [far]) * (2 * width)
        ranks = self._rank(first[:-1], first[1:])
        tree[width : width + n - 1] = array("q", np.where(ranks < FAR, ranks * width + np.arange(n - 1), FAR).tobytes())
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        seen: dict[int, int] = {}

        def put(leaf: int, value: int) -> None:
            k = leaf + width
            tree[k] = value
            k >>= 1
            while k:
                value = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == value:
                    break
                tree[k] = value
                k >>= 1

        def value(a: int, b: int, at: int) -> int:
            if b >= n:
                return far
            key = ids[a] << 20 | ids[b]
            if key not in seen:
                k = bisect_left(self.sorted_pairs, key)
                seen[key] = int(self.ranks[k]) if self.sorted_pairs[k] == key else -1
            return far if seen[key] < 0 else seen[key] * width + at

        while tree[1] < far:
            rank, p = divmod(tree[1], width)
            q = after[p]
            r = after[q]
            ids[p], ids[q] = int(self.merged[rank]), -1
            after[p] = r
            if r <= n:
                before[r] = p
            put(q, far)
            put(p, value(p, r, p))
            if (o := before[p]) >= 0:
                put(o, value(o, p, o))
        return np.array([x for x in ids if x >= 0], np.uint32)

    # -- texts -----------------------------------------------------------------------------------------------------

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if self.kept_bytes > REMEMBERED_BYTES:
            self.forget()
        pieces: list[str] = []
        ends = np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts):
            if self.split is None or not any(s in text for s in self.special):
                pieces += self.pieces(text)
            else:
                for k, part in enumerate(self.split.split(text)):
                    pieces += [part] if k % 2 else self.pieces(part)
            ends[i + 1] = len(pieces)
        before = len(self.known)
        codes = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        if len(self.known) > before:
            self._learn(list(itertools.islice(self.known, before, None)), before)
        first, size = self.start[codes], self.start[codes + 1] - self.start[codes]
        upto = np.append(0, np.cumsum(size))
        ids = self.pool[np.repeat(first - upto[:-1], size) + np.arange(upto[-1])]
        cut = upto[ends]
        return [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def _learn(self, new: list[str], at: int) -> None:
        """Merges new pieces, numbered from ``at`` on, and appends their ids to the pool."""
        raw = [p.encode("utf-8", "surrogatepass") for p in new]
        got: list[np.ndarray] = [None] * len(new)  # type: ignore[list-item]
        rows = [i for i, b in enumerate(raw) if len(b) <= SHORT and new[i] not in self.special]
        for i, ids in zip(rows, self.merge_rows([raw[i] for i in rows]), strict=True):
            got[i] = ids
        for i, p in enumerate(new):
            if got[i] is None:
                got[i] = np.array([self.special[p]], np.uint32) if p in self.special else self.merge_one(raw[i])
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        # A piece costs its characters, its ids and about as much as a key and a value of a dictionary take.
        self.kept_bytes += sum(map(len, raw)) + 4 * int(sizes.sum()) + 160 * len(new)
        end, base = at + len(new), int(self.start[at])
        while len(self.start) <= end:
            self.start = np.append(self.start, np.zeros_like(self.start))
        self.start[at + 1 : end + 1] = base + np.cumsum(sizes)
        while len(self.pool) < self.start[end]:
            self.pool = np.append(self.pool, np.empty_like(self.pool))
        self.pool[base : int(self.start[end])] = np.concatenate(got)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.table.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def bpe_encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_decoded: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id[, columns to keep], ``n_tokens`` long, ``ids`` binary: unsigned 32-bit little-endian[, ``decoded`` string]) for every row of ``docs``.

    ``with_decoded`` also decodes the packed ids again in the same pass.
    """

    def make():
        bpe = codec(tokenizer_path)

        def f(texts):
            ids = bpe.encode(texts)
            packed = [x.astype("<u4").tobytes() for x in ids]
            cols = [[len(x) for x in ids], packed]
            if with_decoded:
                cols.append([bpe.decode(np.frombuffer(b, "<u4")) for b in packed])
            return cols

        f.end = bpe.forget
        return f

    fields = [("n_tokens", pa.int64(), LongType()), ("ids", pa.binary(), BinaryType())] + ([("decoded", pa.string(), StringType())] if with_decoded else [])
    out = StructType([StructField(n, k) for n, _, k in fields])
    return map_text(docs.select(id_col, *keep, text_col), make, out, pa.schema([(n, k) for n, k, _ in fields]), text_col)


def bpe_decode(encoded: DataFrame, tokenizer_path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded`` in place of the packed ids; null ids decode to the empty text."""
    keep = [c for c in encoded.columns if c != ids_col]

    def run(batches):
        bpe = codec(tokenizer_path)
        for b in batches:
            texts = [bpe.decode(np.frombuffer(x or b"", "<u4")) for x in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, "decoded"])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in encoded.schema.fields if f.name != ids_col)
    return encoded.mapInArrow(run, f"{kept}decoded string")


def ids_array(ids):
    """Packed ids as a column array<long>, for consumers that need numbers."""
    at = F.sequence(F.lit(0), (F.length(ids) / 4).cast("int") - 1)
    return F.when(F.length(ids) == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(at, lambda i: sum((F.conv(F.hex(F.substring(ids, i * 4 + k + 1, F.lit(1))), 16, 10).cast("bigint") * (256**k) for k in range(4)), F.lit(0).cast("bigint")))
    )
