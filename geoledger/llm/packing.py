"""Packing: documents into training sequences, by hierarchical multi-length packing.

A document is its token ids and an end id. Each partition routes its documents to context-size tiers (the smallest
tier that holds one; of a longer one, full windows of the largest tier and the rest), packs each tier, and fills
the gap that a piece leaves in its window from shorter tiers, cutting the last filler to fit. What is left at the
end of a partition goes to sequences at smaller powers of two, so that only less than the smallest of these is ever padded.
Sequences of a tier are dealt to step groups of equal tokens. Nothing is shuffled, and a lost task is repeated alone.

Defined results: null text is an empty document (its end id alone); repeated rows are documents of their own; a null
doc_id stays null; other columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import empty_text, texts
from .tokens import encoder, vocabulary_path

TIERS = (256, 512, 1024, 2048)
#: Sequences of at least this many tokens end a partition without padding.
SMALLEST = 16
#: Tokens of a step group, in each tier.
STEP_TOKENS = 16 * 2048
#: Tokens that a task holds before it packs them.
WINDOW_TOKENS = 1 << 20

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, sequence_tokens int, step long"
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]


class Packer:
    """Packs one partition; pieces are (length, document, start) with documents as indices into a list."""

    def __init__(self, partition: int, tiers: tuple[int, ...] = TIERS, smallest: int = SMALLEST, step_tokens: int = STEP_TOKENS):
        self.tiers, self.smallest, self.step_tokens = tiers, smallest, step_tokens
        self.next_sequence = partition << 40
        self.first_step = partition << 40
        self.made = dict.fromkeys(tiers, 0)  # sequences so far, by tier
        self.waiting: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}  # ascending by length

    def _tier(self, length: int) -> int:
        return next(t for t in self.tiers if length <= t)

    def add(self, document: int, length: int) -> Iterator[tuple]:
        start, full = 0, self.tiers[-1]
        while length - start >= full:
            yield from self._sequence(full, [(full, document, start)])
            start += full
        if length > start:
            insort(self.waiting[self._tier(length - start)], (length - start, document, start))

    def _sequence(self, size: int, pieces: list[tuple[int, int, int]]) -> Iterator[tuple]:
        """Rows (document, start, length, sequence, offset, tier, tokens, step)."""
        offset, total = 0, sum(p[0] for p in pieces)
        tier = self._tier(size)
        step = self.first_step + (self.made[tier] * tier // self.step_tokens) * len(self.tiers) + self.tiers.index(tier)
        for length, document, start in pieces:
            yield document, start, length, self.next_sequence, offset, tier, total, step
            offset += length
        self.made[tier] += 1
        self.next_sequence += 1

    def _fill(self, gap: int, below: int) -> list[tuple[int, int, int]]:
        """Pieces of shorter tiers that fill the gap: the largest that fit, the last one cut."""
        got = []
        for tier in [t for t in reversed(self.tiers) if t <= below]:
            row = self.waiting[tier]
            while gap and row and row[0][0] <= gap:
                got.append(row.pop(bisect_right(row, (gap, np.inf, 0)) - 1))
                gap -= got[-1][0]
        for tier in [t for t in self.tiers if t <= below] if gap else ():
            if row := self.waiting[tier]:
                length, document, start = row.pop()
                got.append((gap, document, start))
                insort(self.waiting[self._tier(length - gap)], (length - gap, document, start + gap))
                break
        return got

    def pack(self) -> Iterator[tuple]:
        """Packs the tiers from the longest; pieces that can't fill a window wait."""
        for tier in reversed(self.tiers):
            row = self.waiting[tier]
            while row:
                if sum(p[0] for p in row[-2:]) < tier and not self._enough(tier):
                    break
                piece = row.pop()
                yield from self._sequence(tier, [piece, *self._fill(tier - piece[0], tier)])

    def _enough(self, tier: int) -> bool:
        need = tier
        for t in [t for t in self.tiers if t <= tier]:
            for p in self.waiting[t]:
                need -= p[0]
                if need <= 0:
                    return True
        return False

    def rest(self) -> Iterator[tuple]:
        """What is left, in order of length, to powers of two; less than the smallest is one padded sequence."""
        left = [p for t in reversed(self.tiers) for p in reversed(self.waiting[t])]
        total = sum(p[0] for p in left)
        self.waiting = {t: [] for t in self.tiers}
        while total:
            size = min(self.tiers[-1], 1 << (total.bit_length() - 1))
            size = size if size >= self.smallest else total
            need, pieces = size, []
            while need:
                length, document, start = left.pop(0)
                take = min(length, need)
                pieces.append((take, document, start))
                if take < length:
                    left.insert(0, (length - take, document, start + take))
                need -= take
            total -= size
            yield from self._sequence(size, pieces)


def pack(docs: DataFrame, end_id: int = 1, vocabulary: str | None = None, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """One row for each piece of a document in a sequence. sequence_tokens: what its sequence holds, at most the tier;
    a sequence whose tokens aren't a power of two is padded to the largest tier. step: the step group."""
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        packer = Packer(TaskContext.get().partitionId(), tiers)
        end = end_id.to_bytes(4, "little")
        held: dict[int, tuple[int | None, bytes]] = {}  # documents with pieces that wait, or rows that aren't out yet
        number = 0

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = [[] for _ in COLUMNS]
            for document, start, length, sequence, offset, tier, total, step in rows:
                doc_id, ids = held[document]
                crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])
                for column, value in zip(columns, (doc_id, start, length, crc, len(ids) // 4, sequence, offset, tier, total, step), strict=True):
                    column.append(value)
            waiting = {p[1] for row in packer.waiting.values() for p in row}
            for document in [d for d in held if d not in waiting]:
                del held[document]
            kinds = [pa.int64()] * 7 + [pa.int32()] * 2 + [pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], COLUMNS)

        rows: list[tuple] = []
        tokens = 0
        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(texts(batch)), strict=True):
                held[number] = (doc_id, ids + end)
                rows += packer.add(number, len(ids) // 4 + 1)
                tokens += len(ids) // 4 + 1
                number += 1
                if tokens >= WINDOW_TOKENS:
                    rows += packer.pack()
                    yield out(rows)
                    rows, tokens = [], 0
        rows += packer.pack()
        rows += packer.rest()
        yield out(rows)

    return docs.select("doc_id", empty_text()).mapInArrow(run, SCHEMA)
