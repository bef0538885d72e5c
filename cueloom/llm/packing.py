"""Packing token sequences into fixed-size training rows under several limits at once.

Vector bin packing with the dot-product heuristic: a row has limits on tokens, segments and
loss-bearing tokens; among the waiting examples that still fit, the one whose demand vector has the
largest dot product with the row's remaining capacity is placed next.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueloom.llm.common import slices

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long, segment long"
_END = (0).to_bytes(4, "little")
#: Rows of pieces that a task gathers before it hands them on.
GATHERED = 20_000


@dataclass(frozen=True)
class Limits:
    """Limits of one sequence. `waiting` bounds how many examples a task holds while it chooses."""

    tokens: int = 1024
    segments: int = 128
    loss_tokens: int = 1024
    waiting: int = 1024
    #: Examples may be cut to fill a sequence; if not, those over a limit get a null sequence_id.
    cut: bool = True
    #: Leave the last sequences of a task at powers of two, which need no padding.
    powers: bool = True


@dataclass
class _Piece:
    doc: int | None
    start: int
    ids: bytes  # little-endian unsigned 32-bit
    total: int
    quiet: int  # leading ids of the document that bear no loss

    @property
    def tokens(self) -> int:
        return len(self.ids) // 4

    def loss(self, n: int | None = None) -> int:
        end = self.start + (self.tokens if n is None else n)
        return max(0, end - max(self.start, self.quiet))

    def split(self, n: int) -> tuple[_Piece, _Piece]:
        return _Piece(self.doc, self.start, self.ids[: 4 * n], self.total, self.quiet), _Piece(self.doc, self.start + n, self.ids[4 * n :], self.total, self.quiet)

    def longest(self, tokens: int, loss: int) -> int:
        """The most leading ids within both limits."""
        return min(tokens, self.tokens, max(0, self.quiet - self.start) + loss)


class _Packer:
    """One task's examples, placed as they come; rows of pieces gather in `out`."""

    def __init__(self, limits: Limits, first_id: int):
        self.limits, self.next_id, self.out = limits, first_id, []
        n = limits.waiting
        self.demand = np.zeros((n, 2))  # tokens and loss-bearing tokens of the waiting pieces
        self.pieces: list[_Piece | None] = [None] * n
        self.free = list(range(n))

    def add(self, piece: _Piece) -> None:
        most = self.limits
        if not most.cut and piece.longest(most.tokens, most.loss_tokens) < piece.tokens:
            self.out.append((piece, None, None, None))
            return
        while (n := piece.longest(most.tokens, most.loss_tokens)) < piece.tokens:
            head, piece = piece.split(n)
            if n == most.tokens:
                self._write([head])
            else:
                self._wait(head)
        if piece.tokens == most.tokens:
            self._write([piece])
        else:
            self._wait(piece)

    def _wait(self, piece: _Piece) -> None:
        while not self.free:
            self.fill()
        k = self.free.pop()
        self.pieces[k] = piece
        self.demand[k] = piece.tokens, piece.loss()

    def _take(self, k: int) -> _Piece:
        piece, self.pieces[k] = self.pieces[k], None
        self.demand[k] = 0
        self.free.append(k)
        return piece

    def fill(self) -> None:
        """Fill one sequence from the waiting pieces."""
        most, demand = self.limits, self.demand
        placed: list[_Piece] = []
        tokens, loss = most.tokens, most.loss_tokens
        scale = np.array([most.tokens, most.loss_tokens], float) ** 2
        while tokens and len(placed) < most.segments:
            value = demand @ (np.array([tokens, loss]) / scale)
            value += (most.segments - len(placed)) / most.segments**2
            waits = demand[:, 0] > 0
            fits = waits & (demand[:, 0] <= tokens) & (demand[:, 1] <= loss)
            if fits.any():
                placed.append(self._take(int(np.argmax(np.where(fits, value, -1.0)))))
            else:
                if not most.cut or not waits.any():
                    break
                k = int(np.argmax(np.where(waits, value, -1.0)))
                n = self.pieces[k].longest(tokens, loss)
                if n == 0:
                    break
                head, rest = self.pieces[k].split(n)
                placed.append(head)
                self.pieces[k] = rest
                demand[k] = rest.tokens, rest.loss()
            tokens -= placed[-1].tokens
            loss -= placed[-1].loss()
        self._write(placed)

    def _write(self, placed: list[_Piece]) -> None:
        at = 0
        for k, piece in enumerate(placed):
            self.out.append((piece, self.next_id, at, k))
            at += piece.tokens
        self.next_id += 1

    def close(self) -> None:
        """Place what waits; the remainder that fills no sequence is laid out at powers of two."""
        most = self.limits
        while int(self.demand[:, 0].sum()) >= most.tokens:
            self.fill()
        if not (most.cut and most.powers):
            while len(self.free) < most.waiting:
                self.fill()
            return
        rest = sorted((p for p in self.pieces if p), key=lambda p: -p.tokens)
        self.pieces, self.free = [None] * most.waiting, list(range(most.waiting))
        self.demand[:] = 0
        while rest:
            room = 1 << (min(most.tokens, sum(p.tokens for p in rest)).bit_length() - 1)
            placed, loss, left = [], most.loss_tokens, room
            while left and rest and len(placed) < most.segments:
                piece = rest.pop(0)
                n = piece.longest(left, loss)
                if n == 0:
                    rest.insert(0, piece)
                    break
                if n < piece.tokens:
                    piece, after = piece.split(n)
                    rest.insert(0, after)
                placed.append(piece)
                left, loss = left - n, loss - piece.loss()
            self._write(placed)

    def drain(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        columns = (
            [p.doc for p, *_ in rows],
            [p.start for p, *_ in rows],
            [p.tokens for p, *_ in rows],
            [zlib.crc32(p.ids) for p, *_ in rows],
            [p.total for p, *_ in rows],
            [s for _, s, *_ in rows],
            [o for _, _, o, _ in rows],
            [p.loss() for p, *_ in rows],
            [k for *_, k in rows],
        )
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in PIECES.split(", ")])


def _packed(examples: Iterator[list[tuple[int | None, bytes, int]]], limits: Limits) -> Iterator[pa.RecordBatch]:
    context = TaskContext.get()
    packer = _Packer(limits, (context.partitionId() if context else 0) << 40)
    for batch in examples:
        for doc, ids, quiet in batch:
            if ids:
                packer.add(_Piece(doc, 0, ids, len(ids) // 4, quiet))
        if len(packer.out) >= GATHERED:
            yield packer.drain()
    packer.close()
    if packer.out:
        yield packer.drain()


def _byte_of() -> dict[str, int]:
    """Bytes by the characters that stand for them in the vocabulary of a byte-level tokenizer: printable
    ones for themselves, the others for the characters from 256 on, in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


#: What a byte-level tokenizer splits texts by before it merges bytes. A fixed value, the tokenizers' own.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A much longer run of white space than this overflows the stack of the rank encoder.
GAP = 1000


def _ranked(file: dict):
    """An encoder by merge ranks for a tokenizer file, or None where ranks don't say all.

    Ids are ranks if the file is a plain byte-level BPE whose ids follow its merges; this encoder gives
    the same ids three times as fast.
    """
    import tiktoken

    model, split = file["model"], file.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
    odd = file.get("normalizer") or file.get("truncation") or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or odd:
        return None
    vocab, byte_of = model["vocab"], _byte_of()
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if len(vocab) != 256 + len(merges) or any(vocab.get(a + b) != 256 + k for k, (a, b) in enumerate(merges)):
        return None
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items()}
    return tiktoken.Encoding("ranks", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens={})


def long_gap(text: str) -> bool:
    """Whether a text has GAP or more white-space characters in a row."""
    some = text[:: GAP // 2]  # such a run holds two neighbours of these
    return any(a.isspace() and b.isspace() for a, b in pairwise(some)) and re.search(rf"\s{{{GAP}}}", text) is not None


class Encoder:
    """Ids of texts by a tokenizer file, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.path, self.ranks = path, _ranked(file)
        self.added = [t["content"] for t in file.get("added_tokens") or ()]

    @cached_property
    def tokenizer(self):
        """The file's own tokenizer, for what ranks can't do."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.ranks is None or any(t in text for t in self.added) or long_gap(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.ranks.encode_ordinary(text)
        return array("I", ids).tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file, read once in each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pack_texts(docs: DataFrame, tokenizer: str, limits: Limits = Limits()) -> DataFrame:
    """Tokenize `docs(doc_id, text)` and pack the ids into sequences; one row per piece.

    Each document's ids end with id 0. Every id lies in exactly one piece, sequences fill without
    gaps. A null or empty text is the single id 0; repeated doc_ids are separate documents; a null
    doc_id stays null; other columns are ignored; an empty table gives no rows. `tokenizer` is the
    path of a tokenizer file present on every worker. Narrow: no shuffle, and each task holds at
    most `limits.waiting` pieces beside its current batch. A retried task gives the same rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(tokenizer)
        return _packed(([(d, ids(t) + _END, 0) for d, t in zip(b["doc_id"], b["text"])] for b in slices(batches)), limits)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def pack_examples(examples: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Pack `examples(doc_id, ids ARRAY<INT>, prompt_tokens INT)`: prompt ids bear no loss.

    Null or empty ids give no piece; null prompt_tokens count as 0. Otherwise as pack_texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = lambda ids: b"" if ids is None else array("I", [i or 0 for i in ids]).tobytes()
        return _packed(([(d, whole(i), q) for d, i, q in zip(b["doc_id"], b["ids"], b["prompt_tokens"])] for b in slices(batches)), limits)

    chosen = examples.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"), F.coalesce(F.col("prompt_tokens").cast("int"), F.lit(0)).alias("prompt_tokens"))
    return chosen.mapInArrow(run, PIECES)


def pack_conversations(turns: DataFrame, tokenizer: str, limits: Limits = Limits(segments=16, loss_tokens=512, cut=False, powers=False)) -> DataFrame:
    """Pack instruction data: of `turns(conv_id, turn, role, text)` every reply of the assistant is an
    example whose prompt, the turn before it, bears no loss.

    One row per example as pack_texts gives them for pieces, doc_id being conv_id. Examples stay whole; those over a limit get a null sequence_id. A null or empty text has
    no ids; a reply without ids and prompt gives no row. Turns are told apart by conv_id and turn, and
    repeated turns follow each other in the order of their texts.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    pairs = turns.select("conv_id", "turn", "role", F.col("text").cast("string").alias("text")).withColumn("prompt", F.lag("text").over(order)).filter("role = 'assistant'")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(tokenizer)

        def examples() -> Iterator[list[tuple[int | None, bytes, int]]]:
            for b in slices(batches):
                for conv, prompt, reply in zip(b["doc_id"], b["prompt"], b["text"]):
                    quiet, loud = ids(prompt), ids(reply)
                    yield [(conv, quiet + loud + _END * bool(loud), len(quiet) // 4)]

        return _packed(examples(), limits)

    return pairs.select(F.col("conv_id").cast("long").alias("doc_id"), "prompt", "text").mapInArrow(run, PIECES)
