"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Compiled from a model: a normaliser (dummy prefix, space to U+2581), the pieces as a prefix tree with weight -score, and
byte fallback arcs for characters without a piece. For models trained by merges a further acceptor allows a piece after
another only if merging the two alone leaves them apart; a text's merge result is the one path all of whose neighbours
are so compatible. Composition with an input is lazy, and its path of least tropical weight (sums along a path, minimum
between paths) is found position by position. For unigram models the acceptor allows everything.

Inputs are composed run by run where no piece spans the border of two runs (checked when compiling), and the paths of
runs are kept in a bounded cache.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.sources.tables import arrow_map

SPACE = "▁"
END = ""
#: Bounds of a worker's memory: runs with known paths, compatible pairs known.
CACHE_RUNS, CACHE_PAIRS = 500_000, 1_000_000
#: Weight of a byte fallback arc.
FALLBACK = 1e6


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceTransducer:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        model = SentencePieceProcessor(model_file=path)
        spec.ParseFromString(model.serialized_model_proto())
        form = spec.normalizer_spec
        if form.precompiled_charsmap or form.remove_extra_whitespaces or not form.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only identity normalisation with escaped white space is compiled")
        self.prefix, self.merges = form.add_dummy_prefix, spec.trainer_spec.model_type == 2
        kinds = type(spec).SentencePiece.Type
        normal = {p.piece: (k, p.score) for k, p in enumerate(spec.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        self.bytes = {int(p.piece[3:5], 16): k for k, p in enumerate(spec.pieces) if p.type == kinds.BYTE}
        self.unknown = next(k for k, p in enumerate(spec.pieces) if p.type == kinds.UNKNOWN)
        self.ids = {p: k for p, (k, _) in normal.items()}
        self.scores = {p: s for p, (_, s) in normal.items()}
        self.by_runs = not any(SPACE in p.lstrip(SPACE) for p in normal)
        self.output = [p.piece if p.type in (kinds.NORMAL, kinds.USER_DEFINED) else "" for p in spec.pieces]
        self.byte_of = {k: b for b, k in self.bytes.items()}
        if any(not p.type == kinds.BYTE and k in self.byte_of for k, p in enumerate(spec.pieces)):
            raise ValueError("ids of bytes are not unique")
        self.paths: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, dict[int, bool]] = {}
        self.known_pairs = 0
        # the piece transducer: a node maps a character to the next node, and END to the piece's id
        self.root: dict = {}
        for piece, k in self.ids.items():
            if not self.merges or self.merge(piece) == [piece]:  # merging never makes the others
                node = self.root
                for c in piece:
                    node = node.setdefault(c, {})
                node[END] = k

    def merge(self, text: str) -> list[str]:
        """The merge result, by its definition: the best-scored neighbours first, leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _text(self, code: int) -> str:
        return self.output[code] if code >= 0 else chr(-1 - code)

    def _weight(self, code: int) -> float:
        return -self.scores[self.output[code]] if code >= 0 else FALLBACK

    def _compatible(self, a: int, b: int) -> bool:
        """The acceptor's arc from piece a to piece b, found once."""
        if self.known_pairs >= CACHE_PAIRS:
            self.pairs.clear()
            self.known_pairs = 0
        x, y = self._text(a), self._text(b)
        known = not self.merges or (self.ids.get(x + y) is None or self.merge(x + y) != [x + y]) and self.merge(x + y) == [x, y]
        self.pairs.setdefault(a, {})[b] = known
        self.known_pairs += 1
        return known

    def shortest_path(self, run: str) -> list[int]:
        """Output of the least-weight path of the composition with ``run`` (already normalised).

        Codes are piece ids; a character without a piece, for byte fallback, is -1 minus its code point. In a merge model
        one compatible arc at most enters a position, so the minimum is over one and later arcs needn't be tried.
        """
        n, root, pairs, merges = len(run), self.root, self.pairs, self.merges
        last: list[int | None] = [None] * (n + 1)
        came, weight = [0] * (n + 1), [0.0] * (n + 1)
        for i in range(n):
            before = last[i]
            if before is None and i:
                continue
            after = pairs.get(before) if i else None
            node, j = root, i
            if (first := root.get(run[i])) is None or END not in first:
                arcs = [(i + 1, -1 - ord(run[i]))]
            else:
                arcs = []
            while j < n:
                node = node.get(run[j])
                if node is None:
                    break
                j += 1
                if (code := node.get(END)) is not None and (last[j] is None or not merges):
                    arcs.append((j, code))
            for j, code in arcs:
                if last[j] is not None and (merges or weight[i] + self._weight(code) >= weight[j]):
                    continue
                if i:
                    good = after.get(code) if after is not None else None
                    if good is None:
                        good = self._compatible(before, code)
                        after = pairs.get(before)
                    if not good:
                        continue
                last[j], came[j] = code, i
                if not merges:
                    weight[j] = weight[i] + self._weight(code)
        if n and last[n] is None:  # equal scores can leave no compatible path: the definition decides
            return [self.ids.get(p, -1 - ord(p[0])) for p in self.merge(run)]
        out, j = [], n
        while j:
            out.append(last[j])
            j = came[j]
        return out[::-1]

    def _path_ids(self, run: str) -> tuple[int, ...]:
        if self.merges and SPACE * 2 in run and len(run) < 64:
            # runs of spaces have pieces of equal score, where neighbours alone don't tell the path
            codes = [self.ids.get(p, -1 - ord(p[0])) for p in self.merge(run)]
        else:
            codes = self.shortest_path(run)
        if min(codes) >= 0:
            return tuple(codes)
        out: list[int] = []
        for c in codes:
            out += [c] if c >= 0 else [self.bytes[b] for b in chr(-1 - c).encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]
        return tuple(out)

    def normalise(self, text: str) -> str:
        return (SPACE + text if self.prefix else text).replace(" ", SPACE) if text else ""

    def encode(self, text: str | None) -> list[int]:
        form = self.normalise(text or "")
        runs = _RUNS.findall(form) if self.by_runs else [form] if form else []
        paths, out = self.paths, []
        for run in runs:
            ids = paths.get(run)
            if ids is None:
                if len(paths) >= CACHE_RUNS:
                    for _ in range(CACHE_RUNS // 2):  # the earlier half stays: frequent runs are among it
                        paths.popitem()
                ids = self._path_ids(run)
                if len(run) <= 64:
                    paths[run] = ids
            out.extend(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, byte runs as UTF-8 (bad bytes become U+FFFD), the dummy prefix removed."""
        if not self.byte_of.keys().isdisjoint(ids):
            parts, held = [], bytearray()
            for k in ids:
                if (b := self.byte_of.get(k)) is not None:
                    held.append(b)
                    continue
                if held:
                    parts.append(held.decode("utf-8", "replace"))
                    held.clear()
                parts.append(self.output[k])
            text = "".join(parts) + held.decode("utf-8", "replace")
        else:
            text = "".join(map(self.output.__getitem__, ids))
        text = text.replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


@lru_cache(maxsize=2)
def transducer_for(path: str) -> PieceTransducer:
    return PieceTransducer(path)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """(doc_id, ids, text): the ids of every row, and the text that they decode to.

    Null and empty texts have no ids and decode to the empty text. U+2581 in a text decodes to a space, as in the format.
    Repeated rows stay, null ids pass, other columns are ignored, an empty table stays empty.
    """
    return _run(docs, id_col, text_col, model, False)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, crc32 of the ids as little-endian unsigned 32-bit integers, n_chars decoded, round_trip."""
    return _run(docs, id_col, text_col, model, True)


def _run(docs: DataFrame, id_col: str, text_col: str, model: str | None, digest: bool) -> DataFrame:
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = transducer_for(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = [fst.encode(t) for t in texts]
                back = [fst.decode(x) for x in ids]
                if digest:
                    crc = [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
                    cols = [pa.array([len(x) for x in ids], pa.int64()), pa.array(crc, pa.int64()), pa.array([len(b) for b in back], pa.int64()), pa.array([a == b for a, b in zip(texts, back)])]
                    names = ["n_tokens", "ids_crc32", "n_chars", "round_trip"]
                else:
                    cols, names = [pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.string())], ["ids", "text"]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], ["doc_id", *names])

    schema = "doc_id long, n_tokens long, ids_crc32 long, n_chars long, round_trip boolean" if digest else "doc_id long, ids array<int>, text string"
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).transform(arrow_map, run, schema)
