"""Packing documents into fixed windows by order-preserving dynamic programming.

The documents of a scan partition, in order, form one stream of ids. Windows of at most ``size`` ids are cut from it at
document ends, sentence ends or, where a sentence is long, at inner places, so that padding plus cut penalties is least:
best[j] = min over i of best[i] + padding(i, j) + penalty(j). As padding is size - (S[j] - S[i]), the minimum over the
sliding range of i is kept in a monotone queue. A window of exactly a power of two is not padded; those few lengths are
looked up apart. The programme runs over blocks of the stream; a block's last window is carried into the next block.
No shuffle: partitions are packed where they are read, at the price of one part-filled window each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.wordids import BATCH_BYTES, CACHE_RUNS, default_vocabulary, encoder_for, pieces_of
from lexmill.sources.tables import arrow_map

WINDOW = 2048
#: Costs in ids of padding: ending a window after a sentence inside a document, inside a sentence, and a short window.
SENTENCE_CUT, INNER_CUT, SHORT_WINDOW = 4, 32, 8
#: Sentences longer than this many ids get an inner place to cut each INNER_STEP ids.
LONG_SENTENCE, INNER_STEP = 128, 64
BLOCK_IDS = 1 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def window_cuts(ends: np.ndarray, penalty: np.ndarray, size: int = WINDOW) -> list[int]:
    """Indices into ``ends`` (ascending stream positions) after which the best windows end; the last always does.

    Steps between ends are at most ``size``. Linear time: monotone queue over the admissible window starts.
    """
    place = [0, *ends.tolist()]
    cost = [0, *penalty.tolist()]
    n = len(place)
    best, key, back = [0] * n, [0] * n, [0] * n
    at = {p: k for k, p in enumerate(place)}
    exact = [x for x in (size >> 1, size >> 2, size >> 3) if x]
    queue, head = [0], 0
    for j in range(1, n):
        p = place[j]
        low = p - size
        while place[queue[head]] < low:
            head += 1
        i = queue[head]
        c = key[i] + size - p
        for x in exact:
            k = at.get(p - x)
            if k is not None and best[k] + SHORT_WINDOW < c:
                i, c = k, best[k] + SHORT_WINDOW
        c += cost[j]
        best[j], back[j] = c, i
        key[j] = c = c + p
        while len(queue) > head and key[queue[-1]] >= c:
            queue.pop()
        queue.append(j)
    cuts, j = [], n - 1
    while j:
        cuts.append(j - 1)
        j = back[j]
    return cuts[::-1]


def cut_places(start: np.ndarray, sentence: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Where windows may end, and at what penalty: document ends, sentence ends, inner places of long sentences."""
    ends = start[1:]
    places = np.union1d(ends, sentence)
    step = min(INNER_STEP, size)
    gap = np.diff(np.r_[start[0], places])
    more = np.where(gap > min(LONG_SENTENCE, size), (gap - 1) // step, 0)
    first = np.repeat(places - gap, more)
    inner = first + step * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1)
    penalty = np.where(np.isin(places, ends), 0, SENTENCE_CUT)
    order = np.argsort(places := np.r_[places, inner], kind="stable")
    return places[order], np.r_[penalty, np.full(len(inner), INNER_CUT)][order]


class _Stream:
    """The part of a partition's stream that is not packed yet."""

    def __init__(self, size: int, first_sequence: int):
        self.size, self.sequence = size, first_sequence
        self.ids, self.places, self.penalty = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.docs: list[tuple] = []  # (doc_id, its ids, first position in the stream, end)

    def add(self, doc_ids: list, ids: np.ndarray, start: np.ndarray, cuts: np.ndarray) -> None:
        places, penalty = cut_places(start, cuts, self.size)
        at = len(self.ids)
        self.docs += zip(doc_ids, np.diff(start).tolist(), (start[:-1] + at).tolist(), (start[1:] + at).tolist())
        self.ids = np.concatenate([self.ids, ids])
        self.places, self.penalty = np.concatenate([self.places, places + at]), np.concatenate([self.penalty, penalty])

    def pack(self, last: bool) -> Iterator[tuple]:
        if not len(self.places):
            return
        cuts = window_cuts(self.places, self.penalty, self.size)
        if not last:
            cuts = cuts[:-1]
        begin, d = 0, 0
        for c in cuts:
            end, offset = int(self.places[c]), 0
            while offset < end - begin:
                doc_id, tokens, a, b = self.docs[d]
                x, y = begin + offset, min(b, end)
                crc = zlib.crc32(self.ids[x:y].astype("<u4").tobytes())
                yield doc_id, x - a, y - x, crc, tokens, self.sequence, offset
                offset += y - x
                d += y == b
            begin, self.sequence = end, self.sequence + 1
        keep = cuts[-1] + 1 if cuts else 0
        self.ids, self.places, self.penalty = self.ids[begin:].copy(), self.places[keep:] - begin, self.penalty[keep:]
        self.docs = [(i, n, a - begin, b - begin) for i, n, a, b in self.docs[d:]]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, vocabulary: str | None = None, end_id: int = 1, cache_runs: int = CACHE_RUNS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per piece: doc_id, start and length in its document's ids, crc of the ids, the document's ids,
    sequence_id and the gapless offset there.

    Every id of every row lies in one piece. A null or empty text is the end id alone. Repeated rows are packed as often
    as they occur, a null doc_id stays null, other columns are ignored. No rows in, none out. sequence_id is unique
    (partition number in the upper half), not gapless. Texts of any length: a document may span many windows. cache_runs
    and batch_bytes bound a worker's memory.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path, end_id, cache_runs)
        stream = _Stream(size, TaskContext.get().partitionId() << 32)
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def rows(last: bool) -> Iterator[pa.RecordBatch]:
            if found := list(stream.pack(last)):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names)

        for batch in batches:
            for part in pieces_of(batch, 1, batch_bytes):
                got = encoder.encode(part.column(1))
                stream.add(part.column(0).to_pylist(), got.ids, got.start, got.cuts)
                if len(stream.ids) >= BLOCK_IDS:
                    yield from rows(False)
        yield from rows(True)
        pa.default_memory_pool().release_unused()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).transform(arrow_map, run, SCHEMA)
