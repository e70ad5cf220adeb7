"""Chat formatting by token-level assembly.

Role and text of every turn are encoded apart, without special tokens, and reserved ids are spliced between them:
OPEN role BODY text CLOSE. The loss mask is the prefix sum of +1 where an assistant text begins and -1 where it ends.
Reserved ids have printed forms; where a text or role holds one of these control strings, or the escape character, it is
escaped before encoding, so the printed conversation can be cut at its control strings too, and nothing is lost.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.sources.tables import arrow_map

# The template's control strings, and strings of common templates that are escaped in content as well.
OPEN, BODY, CLOSE = "<turn>", "<text>", "</turn>"
FOREIGN = ("<|endoftext|>", "<|im_start|>", "<|im_end|>", "### Assistant:", "### User:", "### System:", "[INST]", "[/INST]")
ESCAPE = "\\"
LOSS_ROLE = "assistant"
FORMATTED = "conv_id long, turn long, tie long, ids array<int>, mask array<byte>"
_ESCAPED = re.compile("|".join(map(re.escape, sorted((OPEN, BODY, CLOSE, ESCAPE, *FOREIGN), key=len, reverse=True))))
_UNESCAPE = re.compile(re.escape(ESCAPE) + "(" + _ESCAPED.pattern + ")")


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: ESCAPE + m.group(), text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Assembler:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        first = self.tokenizer.get_vocab_size()
        self.open, self.body, self.close = range(first, first + 3)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def assemble(self, roles: list[str], texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and loss mask of each turn."""
        for role, r, t in zip(roles, self._encode([escape(x) for x in roles]), self._encode([escape(x) for x in texts])):
            ids = np.array([self.open, *r, self.body, *t, self.close], np.int32)
            step = np.zeros(len(ids), np.int8)
            if role == LOSS_ROLE and t:
                step[len(r) + 2] += 1
                step[-1] -= 1
            yield ids, np.cumsum(step, dtype=np.int8)

    def parse(self, ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, str, int]:
        """role, text, the text under the mask and the printed length of one turn, from its ids alone."""
        at = np.flatnonzero(ids >= self.open)
        if ids[at].tolist() != [self.open, self.body, self.close] or at[0] != 0 or at[2] != len(ids) - 1:
            raise ValueError("not one turn")
        decode = lambda x: self.tokenizer.decode(x.tolist(), skip_special_tokens=False)
        role, text, loss = decode(ids[1 : at[1]]), decode(ids[at[1] + 1 : -1]), decode(ids[mask > 0])
        return unescape(role), unescape(text), unescape(loss), len(role) + len(text) + len(OPEN + BODY + CLOSE)


@lru_cache(maxsize=2)
def assembler_for(path: str) -> Assembler:
    return Assembler(path)


def format_turns(rows: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row a turn: conv_id, turn, tie, ids, mask. In the order of turn and tie a conversation's rows are its output.

    Null roles and texts are empty, null conv_ids one conversation, null turns come first. Equal turns are ordered by a
    hash of role and text. Repeated rows stay; other columns are ignored. Rows are independent, so a huge conversation
    is encoded by many tasks.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assembler = assembler_for(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                done = list(assembler.assemble(part.column(3).to_pylist(), part.column(4).to_pylist()))
                ids, mask = pa.array([x for x, _ in done], pa.list_(pa.int32())), pa.array([m for _, m in done], pa.list_(pa.int8()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), ids, mask], ["conv_id", "turn", "tie", "ids", "mask"])

    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    cols = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *text)
    return cols.select("conv_id", "turn", F.xxhash64("role", "text").alias("tie"), "role", "text").transform(arrow_map, run, FORMATTED)


def read_formatted(spark: SparkSession, path: str, vocabulary: str | None = None) -> DataFrame:
    """conv_id, turn, tie, role, text, loss, chars of every turn, parsed back from the written ids and masks."""
    vocab = vocabulary or default_vocabulary()
    names = ["conv_id", "turn", "tie", "role", "text", "loss", "chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assembler = assembler_for(vocab)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                rows = [assembler.parse(np.array(i.as_py(), np.int32), np.array(m.as_py(), np.int8)) for i, m in zip(part.column(3), part.column(4))]
                cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.string(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *cols], names)

    return spark.read.schema(FORMATTED).parquet(path).transform(arrow_map, run, "conv_id long, turn long, tie long, role string, text string, loss string, chars long")


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation: n_turns, hashes of its turns and of the text under the loss mask, and lengths.

    A hash needs its conversation's turns in order, so they are sorted together and streamed: a task holds one batch, and
    of a conversation only the running hashes, however long it is.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None

        def row() -> list:
            conv, n, turns, loss_chars, loss, chars = now
            return [conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars]

        def batch_of(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            done = []
            cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "role", "text", "loss", "chars")]
            for conv, role, text, loss, chars in zip(*cols):
                if now is None or now[0] != conv:
                    if now is not None:
                        done.append(row())
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                now[3] += len(loss)
                now[4].update(loss.encode())
                now[5] += chars
            if done:
                yield batch_of(done)
        if now is not None:
            yield batch_of([row()])

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "tie")
    return ordered.select("conv_id", "role", "text", "loss", "chars").transform(arrow_map, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
