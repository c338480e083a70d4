"""Sum-of-squares online packing of tokenised documents into windows.

A level array counts the partially filled windows by fill level. Each document goes to the level whose
choice makes the sum of the squared counts smallest; a document of a window or more first fills whole
windows of its own. Documents are dealt to tasks as the input's splits are, each task packs its own stream
with its own array, and there is no shuffle (a table of fewer splits than cores is dealt out first, so there the windows depend on
the number of cores). A task holds the ids of its open windows, so at most those of its own split. When a task's stream ends, the emptiest windows are poured into the gaps of the fullest, cutting documents where a gap ends, so
that one partial window is left; at the end that one is cut into windows of powers of two, which need no padding.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import common

REMEMBERED = 500_000
GROUP = 2_000_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
OUT = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])


#: Letters that any version of Unicode knows and that lower-casing keeps single, and the ASCII signs apart from the apostrophe.
LETTER, SIGN = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f", r"!-&(-@\[-`{-~"
#: Runs between blanks, cut where letters meet signs; what holds anything else stays whole.
CUT = re.compile(rf"[{LETTER}]++(?=[{SIGN}' \n]|\Z)|[{SIGN}]++(?=[{LETTER} \n]|\Z)|[^ \n]+")
PLAIN = re.compile(r"[\0-\u012f\u0131-\u024f]*")


class Words:
    """Ids of whole texts by a tokenizer that lower-cases and whose pieces cross no blank and no edge between a letter
    and a sign, but for contractions: each distinct run is encoded once. Texts that may hold an added token are cut at
    blanks alone."""

    def __init__(self, content: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end, self.known = Tokenizer.from_str(content), int(end).to_bytes(4, "little"), {}
        self.added = {t["content"][:2] for t in json.loads(content)["added_tokens"]}

    def runs(self, text: str) -> list[str]:
        low = text.lower() if PLAIN.fullmatch(text) else text
        if any(a in text or a in low for a in self.added):
            return text.replace("\n", " ").split(" ")
        return CUT.findall(low)

    def ids(self, texts: list[str | None]) -> Iterator[bytes]:
        """Packed ids of each text and the end, for groups of at most GROUP characters (one longer text is a group)."""
        group, held = [], 0
        for text in texts:
            text = text or ""
            if group and held + len(text) > GROUP:
                yield from self._look_up(group)
                group, held = [], 0
            group.append(self.runs(text))
            held += len(text)
        yield from self._look_up(group)

    def _look_up(self, group: list[list[str]]) -> Iterator[bytes]:
        met = set().union(*group)
        need = met.difference(self.known)
        if len(self.known) + len(need) > REMEMBERED:
            self.known.clear()
            need = met
        need = list(need)
        for a in range(0, len(need), 20_000):
            part = need[a : a + 20_000]
            self.known.update((w, array("I", e.ids).tobytes()) for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True))
        return (b"".join(map(self.known.__getitem__, runs)) + self.end for runs in group)


@lru_cache(maxsize=2)
def tokenizer(content: str, end: int) -> Words:
    return Words(content, end)


class Packer:
    """Packs (key, ids) as they come; ``done`` holds the windows that are final, as lists of pieces.

    A piece is (key, first id's place in its document, ids, ids in the document).
    """

    def __init__(self, capacity: int = 4096):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.level: list[list[list[tuple]]] = [[] for _ in range(capacity + 1)]
        self.done: list[list[tuple]] = []

    def put(self, fill: int, window: list[tuple]) -> None:
        if fill == self.capacity:
            self.done.append(window)
        elif fill:
            self.level[fill].append(window)
            self.count[fill] += 1

    def take(self, fill: int) -> list[tuple]:
        self.count[fill] -= 1
        return self.level[fill].pop()

    def best(self, size: int) -> int:
        """The fill level (0: a new window) at which a document of ``size`` leaves the least sum of squares."""
        used = np.flatnonzero(self.count[1 : self.capacity - size + 1]) + 1
        if not len(used):
            return 0
        above = self.count[used + size] * (used + size < self.capacity)
        cost = 2 * (above - self.count[used]) + np.where(used + size < self.capacity, 2, 1)
        k = len(cost) - 1 - int(np.argmin(cost[::-1]))  # ties: the fullest
        return int(used[k]) if cost[k] <= 2 * self.count[size] + 1 else 0

    def add(self, key, ids: bytes) -> None:
        total, at = len(ids) // 4, 0
        while total - at >= self.capacity:
            self.done.append([(key, at, ids[4 * at : 4 * (at + self.capacity)], total)])
            at += self.capacity
        if size := total - at:
            fill = self.best(size)
            window = self.take(fill) if fill else []
            window.append((key, at, ids[4 * at :], total))
            self.put(fill + size, window)

    def pour(self) -> list[tuple]:
        """Fills the fullest open windows from the emptiest; returns the one that stays partial."""
        order = [(fill, w) for fill in range(self.capacity) for w in self.level[fill]]  # emptiest first
        self.count[:] = 0
        for fill in range(self.capacity):
            self.level[fill] = []
        lo, hi = 0, len(order) - 1
        while lo < hi:
            (have, donor), (fill, window) = order[lo], order[hi]
            gap = self.capacity - fill
            while gap and donor:
                key, at, ids, total = donor.pop()
                n = min(gap, len(ids) // 4)
                window.append((key, at, ids[: 4 * n], total))
                if 4 * n < len(ids):
                    donor.append((key, at + n, ids[4 * n :], total))
                gap, have = gap - n, have - n
            order[lo] = (have, donor)
            if not gap:
                self.done.append(window)
                hi -= 1
            else:
                order[hi] = (self.capacity - gap, window)
            if not donor:
                lo += 1
        rest = order[hi][1] if lo == hi and order[hi][1] else []
        self.put(sum(len(p[2]) // 4 for p in rest), rest)
        return rest

    def finish(self) -> None:
        rest = self.pour()
        left = sum(len(p[2]) // 4 for p in rest)
        if left:
            self.take(left)
        while left:
            size, window = 1 << (left.bit_length() - 1), []
            left -= size
            while size:
                key, at, ids, total = rest.pop()
                n = min(size, len(ids) // 4)
                window.append((key, at, ids[: 4 * n], total))
                if 4 * n < len(ids):
                    rest.append((key, at + n, ids[4 * n :], total))
                size -= n
            self.done.append(window)


def packed(docs: DataFrame, content: str, end: int = 2, capacity: int = 4096) -> DataFrame:
    """One row per piece of a document in a window of ``capacity`` tokens.

    Null texts count as empty: they are their end token alone. A text of a window or more first fills whole windows, however long it is.
    Among fill levels of equal cost (a tie) the fullest is taken. Null ids stay null, repeated rows are packed
    each on their own, an empty table gives no rows and other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(content)  # a vocabulary file, under 2 MB

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = tokenizer(shared.value, end), Packer(capacity)
        base, done = TaskContext.get().partitionId() << 40, 0

        def flush() -> pa.RecordBatch:
            nonlocal done
            rows = []
            for window in packer.done:
                offset = 0
                for key, at, ids, total in window:
                    n = len(ids) // 4
                    rows.append((key, at, n, zlib.crc32(ids), total, base + done, offset))
                    offset += n
                done += 1
            packer.done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 7)], schema=OUT)

        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), words.ids(batch.column(1).to_pylist()), strict=True):
                packer.add(key, ids)
            yield flush()
        packer.finish()
        yield flush()

    return common.spread(docs.select("doc_id", "text")).mapInArrow(pack, SCHEMA)


def vocabulary() -> str:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return packed(common.table(spark, sf_dir, "documents"), vocabulary())
