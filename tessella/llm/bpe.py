"""Byte-level BPE encoding and decoding.

Each piece of the split pattern is encoded on its own. A segment tree over the byte positions of a piece
keeps, at every node, the smallest rank among the pairs that start below it; walking down and going left on
ties finds the leftmost minimum, and a merge updates the leaves of the live neighbours only, in logarithmic
time. The trees of many pieces of like length are kept as columns of one array, so that a step advances all of them; those of
few are lists, which a long piece needs (an unbroken run of letters of any length is one piece).
Distinct pieces are encoded once and remembered in a table of bounded size.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Unicode White_Space, spelled out: the engines disagree on U+001C to U+001F.
BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A coarse cut at blanks that any match of the fine pattern respects.
COARSE = regex.compile(rf" ?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")
NONE = np.int32(2**31 - 1)
REMEMBERED = 500_000
CELLS = 1 << 18
#: Fewer pieces of one width than this are merged one by one.
FEW = 40
GROUP = 2_000_000


class Codec:
    """Encoder and decoder for a table of ranks; ``ranks`` is the content of a .tiktoken file."""

    def __init__(self, ranks: bytes, pattern: str):
        self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.word = dict(zip(self.rank.values(), self.rank.keys(), strict=True))
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        self.fine = regex.compile(pattern.replace(r"[^\s", f"[^{BLANK}").replace(r"\S", f"[^{BLANK}]").replace(r"\s", f"[{BLANK}]"))
        pairs = sorted((self.rank[t[:i]] << 32 | self.rank[t[i:]], r) for t, r in self.rank.items() for i in range(1, len(t)) if t[:i] in self.rank and t[i:] in self.rank)
        self.ranked = dict(pairs)
        self.pair = np.array([p[0] for p in pairs], np.int64)
        self.merged = np.array([p[1] for p in pairs], np.int32)
        self.packed = {r: r.to_bytes(4, "little") for r in self.word}
        self.known: dict[str, bytes] = {}

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where((self.pair[at] == key) & (right >= 0), self.merged[at], NONE)

    def merge(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids, as little-endian bytes, of pieces of at most ``width`` bytes (a power of two)."""
        n, size = len(pieces), np.array([len(p) for p in pieces])
        raw = np.zeros((n, width), np.uint8)
        raw[np.arange(width) < size[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
        live = (np.arange(width) < size[:, None]).T
        ids = np.where(live, self.byte[raw.T], -1).astype(np.int32)  # position x piece; -1: none
        after = np.where(np.arange(1, width + 1)[:, None] < size, np.arange(1, width + 1)[:, None], width).astype(np.int32)
        before = np.broadcast_to(np.arange(-1, width - 1, dtype=np.int32)[:, None], (width, n)).copy()
        tree = np.full((2 * width, n), NONE, np.int32)
        tree[width : 2 * width - 1] = self.pair_rank(ids[:-1], ids[1:])
        for k in range(width - 1, 0, -1):
            tree[k] = np.minimum(tree[2 * k], tree[2 * k + 1])
        ids = np.vstack([ids, np.full((1, n), -1, np.int32)])  # row ``width`` stands for the end

        def put(at, col, value):
            k = at + width
            tree[k, col] = value
            while (k := k >> 1)[0]:
                tree[k, col] = np.minimum(tree[2 * k, col], tree[2 * k + 1, col])

        col = np.flatnonzero(tree[1] < NONE)
        while len(col):
            k = np.ones(len(col), np.int64)
            while k[0] < width:
                k = 2 * k + (tree[2 * k, col] > tree[2 * k + 1, col])
            at, rank = k - width, tree[1, col]
            gone = after[at, col].astype(np.int64)
            nxt = after[gone, col].astype(np.int64)
            ids[at, col], ids[gone, col], after[at, col] = rank, -1, nxt
            inner = nxt < width
            before[nxt[inner], col[inner]] = at[inner]
            put(gone, col, NONE)
            put(at, col, self.pair_rank(rank, ids[nxt, col]))
            prev = before[at, col].astype(np.int64)
            if len(has := np.flatnonzero(prev >= 0)):
                put(prev[has], col[has], self.pair_rank(ids[prev[has], col[has]], rank[has]))
            col = col[tree[1, col] < NONE]
        kept = ids[:width].T
        flat, ends = kept[kept >= 0].astype("<u4").tobytes(), np.cumsum((kept >= 0).sum(1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def merge_long(self, piece: bytes) -> bytes:
        """The same for one piece, by a tree in lists: about ten microseconds a merge, however long the piece. An update stops
        where a node's minimum stays as it was."""
        n, rank, none = len(piece), self.ranked, int(NONE)
        width = 1 << (n - 1).bit_length()
        first = self.byte[np.frombuffer(piece, np.uint8)]
        leaf = np.full(width, NONE, np.int32)
        leaf[: n - 1] = self.pair_rank(first[:-1], first[1:])
        rows = [leaf]
        while len(rows[-1]) > 1:
            rows.append(rows[-1].reshape(-1, 2).min(1))
        tree = [none, *np.concatenate(rows[::-1]).tolist()]
        ids, after, before = first.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))

        def put(k: int, value: int) -> None:
            tree[k] = value
            while k > 1:
                left, right = tree[k & -2], tree[k | 1]
                least = left if left < right else right
                k >>= 1
                if tree[k] == least:
                    break
                tree[k] = least

        while (best := tree[1]) != none:
            k = 1
            while k < width:
                k *= 2
                if tree[k] > tree[k + 1]:
                    k += 1
            at = k - width
            gone = after[at]
            nxt = after[gone]
            ids[at], ids[gone], after[at] = best, -1, nxt
            put(width + gone, none)
            if nxt < n:
                before[nxt] = at
                put(k, rank.get(best << 32 | ids[nxt], none))
            else:
                put(k, none)
            if at:
                prev = before[at]
                put(width + prev, rank.get(ids[prev] << 32 | best, none))
        kept = np.array(ids, np.int64)
        return kept[kept >= 0].astype("<u4").tobytes()

    def learn(self, chunks: set[str]) -> None:
        """Remembers the ids of coarse chunks."""
        split, parts = self.fine.findall, {}
        whole: list[str] = []  # chunks that are one piece
        for c in chunks:
            pieces = split(c)
            if len(pieces) == 1:
                whole.append(c)
            else:
                parts[c] = pieces
        self.known.update(self.pieces(whole))
        done = dict(self.pieces({p for ps in parts.values() for p in ps}))
        self.known.update((c, b"".join([done[p] for p in ps])) for c, ps in parts.items())

    def pieces(self, texts: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """(piece, ids): a piece that is a token stands for itself, the others are merged with those of like length."""
        rank, by_width = self.rank.get, {}
        for text in texts:
            raw = text.encode()
            if (r := rank(raw)) is not None:
                yield text, self.packed[r]
            else:
                at = by_width.setdefault((len(raw) - 1).bit_length(), ([], []))
                at[0].append(text)
                at[1].append(raw)
        for bits, (names, raws) in by_width.items():
            if len(raws) < FEW:  # the columns of one array pay only where many trees advance together
                yield from zip(names, map(self.merge_long, raws), strict=True)
                continue
            step = max(FEW, CELLS >> bits)
            for a in range(0, len(raws), step):
                yield from zip(names[a : a + step], self.merge(raws[a : a + step], 1 << bits), strict=True)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text. Texts are taken in groups of at most GROUP characters (one longer text is a group),
        so that the trees of all chunks a group adds advance together."""
        out: list[bytes] = []
        group: list[list[str]] = []
        held = 0
        for text in texts:
            text = text or ""
            if group and held + len(text) > GROUP:
                out += self._look_up(group)
                group, held = [], 0
            group.append(COARSE.findall(text))
            held += len(text)
        return out + self._look_up(group)

    def _look_up(self, group: list[list[str]]) -> list[bytes]:
        met = set().union(*group)
        need = met.difference(self.known)
        if len(self.known) + len(need) > REMEMBERED:
            self.known.clear()
            need = met
        self.learn(need)
        return [b"".join(map(self.known.__getitem__, chunks)) for chunks in group]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.word.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(ranks: bytes, pattern: str) -> Codec:
    return Codec(ranks, pattern)


def load(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoded(text: Column, path: str, pattern: str) -> Column:
    """Ids of a text column as little-endian unsigned 32-bit integers; null counts as empty."""
    ranks = load(path)

    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        return pa.array(codec(ranks, pattern).encode(texts.to_pylist()), pa.binary())

    return encode(text)


def decoded(ids: Column, path: str, pattern: str) -> Column:
    """Bytes that packed ids stand for; null stays null, an unknown id is an error."""
    ranks = load(path)

    @F.arrow_udf("binary")
    def decode(rows: pa.Array) -> pa.Array:
        own = codec(ranks, pattern)
        return pa.array([None if x is None else own.decode(x) for x in rows.to_pylist()], pa.binary())

    return decode(ids)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (packed) and decoded (the bytes they stand for) of each row.

    One pass of Arrow batches does both: were they two functions of one plan, the optimiser could put the encoder in twice.
    """
    ranks = load(path)

    def both(batches):
        own = codec(ranks, pattern)
        for batch in batches:
            ids = own.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(map(own.decode, ids), pa.binary())], ["doc_id", "ids", "decoded"])

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(both, f"doc_id {doc_id}, ids binary, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, number of tokens, digest of the ids and of the bytes decoded from them.

    Null and empty texts have no tokens; repeated rows and null ids stay; other columns are ignored; an empty table gives no rows.
    Very long texts are encoded whole; a piece of n bytes without a break takes time n log n (about five seconds for a million letters)
    and some 200 n bytes of memory. Of pairs of the same rank (a tie) the leftmost is merged first.
    """
    rows = round_trip(common.spread(docs.select("doc_id", "text")), path, pattern)
    return rows.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
