"""Token ids of whole texts with the tokenizers library, each distinct white-space-free run encoded once per batch.

The vocabulary's normaliser and splitter never join anything across ASCII white space, so a text's ids are those of its
runs in order. Runs already seen come from a bounded cache; a full cache is emptied, which changes no result.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bounds of one worker's memory: cached runs, and bytes of text turned into arrays at once.
CACHE_RUNS = 350_000
BATCH_BYTES = 6 << 20
#: Stands between runs that are encoded together; a run that holds it is encoded apart. So many runs a text.
MARK, JOINED = "\x00", 2000
_PLAIN = r"""^(?P<w>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<m>[!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]*)$"""
_LETTERS = r"^[a-zß-öø-ÿ]+$"
_SENTENCE_END = r"""[.!?…。！？]["'”’»)\]]*$"""


@dataclass
class Encoded:
    """Ids of some rows: row r has ids[start[r]:start[r + 1]], the end id included; cuts are positions after a sentence."""

    ids: np.ndarray
    start: np.ndarray
    cuts: np.ndarray


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def ragged(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """flat[start[k]:start[k] + length[k]] for all k, joined."""
    total = int(length.sum())
    shift = np.repeat(start - np.cumsum(length) + length, length)
    return flat[shift + np.arange(total)]


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write the letters beyond ASCII that _PLAIN takes: a character for each UTF-8 byte."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in printable)}
    return {c: "".join(other.get(b, chr(b)) for b in chr(c).encode()) for c in range(0xC0, 0x100)}


def _letters_alone(config: dict) -> bool:
    """Whether a lower-case run of letters reaches the model as it is, byte by byte: only then may steps before it be left out."""
    steps = config.get("normalizer") or {}
    normal = {x["type"] for x in steps.get("normalizers", [steps] if steps else [])}
    before = (config.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = [x["type"] for x in before] == ["Split", "ByteLevel"] and "[\\p{L}]+|" in before[0]["pattern"].get("Regex", "")
    return split and not before[1]["use_regex"] and not before[1]["add_prefix_space"] and normal <= {"NFC", "Replace", "Lowercase"} and config["model"]["type"] == "BPE"


class RunEncoder:
    """Use encoder_for: one a process, so that tasks of a reused worker share vocabulary and cache."""

    def __init__(self, path: str, end_id: int = 1, cache_runs: int = CACHE_RUNS):
        self.cache_runs = cache_runs
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        self.model = self.tokenizer.model if _letters_alone(json.loads(Path(path).read_text())) else None
        self.letters = _byte_letters()
        sample = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = sample[0] if len(sample) == 1 else None
        self.known = pa.array([], pa.large_string())  # the run of every slot
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.start, self.length = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def _shrink(self) -> None:
        """Keep the runs seen first: the frequent ones are among them."""
        n = min(len(self.known), self.cache_runs // 2)
        self.known = self.known.take(pa.array(np.arange(n)))
        self.used = int(self.start[n - 1] + self.length[n - 1]) if n else 0

    def _encode_letters(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Runs of lower-case letters go to the model at once."""
        tokenize, letters = self.model.tokenize, self.letters
        coded = [[t.id for t in tokenize(r if r.isascii() else r.translate(letters))] for r in runs]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        return np.fromiter(chain.from_iterable(coded), np.uint32, int(sizes.sum())), sizes

    def _encode_runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all runs, joined, and how many each has. Runs go to the library together, marks between them."""
        plain = self.mark is not None and not any(MARK in r for r in runs)
        if plain:
            sep = f" {MARK} "
            texts = [sep.join(runs[k : k + JOINED]) for k in range(0, len(runs), JOINED)]
            ids = np.concatenate([np.array([*e.ids, self.mark], np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
            at = np.flatnonzero(ids == self.mark)
            if len(at) == len(runs):
                return ids[ids != self.mark], np.diff(at, prepend=-1) - 1
        coded = [e.ids for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        return np.fromiter(chain.from_iterable(coded), np.uint32, int(sizes.sum())), sizes

    def _add(self, runs: pa.Array, encode) -> np.ndarray:
        """Slots of runs that have none yet."""
        if not len(runs):
            return np.empty(0, np.int64)
        ids, sizes = encode(runs.to_pylist())
        n, need = len(self.known), self.used + len(ids)
        if need > len(self.flat):
            self.flat = np.resize(self.flat, need + (need >> 1))
        if n + len(runs) > len(self.start):
            more = n + len(runs) + (n >> 1)
            self.start, self.length = np.resize(self.start, more), np.resize(self.length, more)
        self.flat[self.used : need] = ids
        self.start[n : n + len(runs)] = self.used + np.cumsum(sizes) - sizes
        self.length[n : n + len(runs)] = sizes
        self.used = need
        self.known = pa.concat_arrays([self.known, runs])
        return np.arange(n, n + len(runs))

    def _slots(self, parts: pa.Array) -> np.ndarray:
        """The cache slots of strings, those not there encoded first."""
        coded = parts.dictionary_encode()
        runs = coded.dictionary
        slot = pc.fill_null(pc.index_in(runs, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(new := np.flatnonzero(slot < 0)):
            fresh = runs.take(pa.array(new))
            direct = pc.match_substring_regex(fresh, _LETTERS).to_numpy(zero_copy_only=False).astype(bool) & (self.model is not None)
            for some, encode in ((direct, self._encode_letters), (~direct, self._encode_runs)):
                slot[new[some]] = self._add(fresh.filter(pa.array(some)), encode)
        return slot[coded.indices.to_numpy(zero_copy_only=False)]

    def _distinct(self, coded: pa.DictionaryArray) -> tuple[np.ndarray, ...]:
        """Per word its distinct run; per distinct run where its ids start, how many they are, and if it ends a sentence.

        A run of plain letters with closing marks is the lower-case letters' ids, then the marks', where the vocabulary
        lower-cases and splits there (an apostrophe may begin a piece with letters and is no such mark). So case and marks
        don't multiply what is encoded.
        """
        runs = coded.dictionary
        if len(self.known) > self.cache_runs:
            self._shrink()
        if self.model is not None:
            split = pc.extract_regex(runs, _PLAIN)
            plain = pc.is_valid(split)
            body = pc.if_else(plain, pc.utf8_lower(pc.struct_field(split, "w")), runs)
            marks = pc.if_else(plain, pc.struct_field(split, "m"), pa.scalar("", runs.type))
        else:
            body, marks = runs, pa.repeat(pa.scalar("", runs.type), len(runs))
        slots = self._slots(pa.concat_arrays([body, marks])).reshape(2, -1).T.ravel()
        sizes = self.length[slots]
        flat = ragged(self.flat, self.start[slots], sizes)
        length = sizes[0::2] + sizes[1::2]
        ends = pc.match_substring_regex(runs, _SENTENCE_END).to_numpy(zero_copy_only=False).astype(bool)
        return coded.indices.to_numpy(zero_copy_only=False), np.cumsum(length) - length, length, flat, ends

    def encode(self, texts: pa.Array) -> Encoded:
        """texts: strings, null counts as empty."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = words.flatten().dictionary_encode()
        index, start, length, flat, ends = self._distinct(coded)
        first = words.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        first -= first[0]
        row = np.repeat(np.arange(len(texts)), np.diff(first))
        length = length[index]
        body = ragged(flat, start[index], length)
        before = np.r_[0, np.cumsum(length)]
        start = before[first] + np.arange(len(texts) + 1)  # each earlier row has an end id too
        ids = np.empty(len(body) + len(texts), np.uint32)
        ends_at = start[1:] - 1
        mask = np.ones(len(ids), bool)
        mask[ends_at] = False
        ids[mask], ids[ends_at] = body, self.end_id
        cuts = (before[1:] + row)[ends[index]]
        return Encoded(ids, start, cuts)


@lru_cache(maxsize=2)
def encoder_for(path: str, end_id: int = 1, cache_runs: int = CACHE_RUNS) -> RunEncoder:
    return RunEncoder(path, end_id, cache_runs)


def pieces_of(batch: pa.RecordBatch, column: int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ``most`` bytes of text (one row at least)."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // most
    edges = np.r_[0, np.flatnonzero(np.diff(part)) + 1, batch.num_rows]
    for a, b in zip(edges[:-1], edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)
