"""Sequence packing as vector bin packing by the dot-product heuristic.

A sequence has limits on tokens, segments and loss-bearing tokens. The open
sequence takes, from a small pool of waiting pieces, the one whose demand has
the largest dot product with what is left of the limits. When none fits whole,
the largest is cut to fill the sequence. A sequence that stays short is written
as sequences of power-of-two lengths, which need no padding.
"""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from . import common as C

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
#: Texts of only these characters, without apostrophes or special strings, are
#: cut into runs of letters and of other marks, which the tokenizer treats apart.
_PLAIN = re.compile(r"[\t\n\r\x20-\x26\x28-\x7eÀ-ÖØ-öø-ÿ]*")
_RUN = re.compile(r"[a-zß-öø-ÿ]+|[^a-zß-öø-ÿ\s]+")


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 64
    loss_tokens: int = 2048

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss_tokens], float)


def _byte_letters() -> dict[int, str]:
    """How byte-level tokenizers write bytes: printable ones as they are, the rest from U+0100 on in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder(dict):
    """The tokenizer's ids of whole texts.

    As a dictionary it holds the ids of words, as bytes, up to a bound. A new
    word's runs of letters go straight to the tokenizer's model; other runs and
    texts with unusual characters go through the whole tokenizer.
    """

    def __init__(self, path: str, remembered: int = 600_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tk, self.remembered, self.letters = Tokenizer.from_file(path), remembered, _byte_letters()
        self.tk.no_truncation()
        self.tk.no_padding()
        self.model = self.tk.model

    def __missing__(self, word: str) -> bytes:
        if word.isalpha():
            run = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.model.tokenize(run)]
            out = struct.pack(f"<{len(ids)}i", *ids)
        elif len(runs := _RUN.findall(word)) > 1:
            out = b"".join([self[r] for r in runs])
        else:
            out = np.array(self.tk.encode(word, add_special_tokens=False).ids, "<i4").tobytes()
        if len(self) >= self.remembered:
            self.clear()
        self[word] = out
        return out

    def encode(self, text: str) -> np.ndarray:
        if not _PLAIN.fullmatch(text) or "<|" in text:
            return np.array(self.tk.encode(text, add_special_tokens=False).ids, np.int32)
        return np.frombuffer(b"".join(map(self.__getitem__, text.lower().split())), "<i4")


class Packer:
    """Pieces of documents in, rows of placed pieces out; holds a bounded pool only."""

    POOL = 128

    def __init__(self, limits: Limits, first_id: int):
        self.limits, self.caps, self.next_id = limits, limits.vector(), first_id
        self.pool: list[tuple] = []  # key, ids, start, total, loss flags or None
        self.demand = np.empty((self.POOL + 2, 3))  # of the pool, row by row
        self.rows: list[tuple] = []
        self.open: list[tuple] = []
        self.left = self.caps.copy()

    def add(self, key, ids: np.ndarray, loss: np.ndarray | None = None) -> None:
        at, n, most = 0, len(ids), min(self.limits.tokens, self.limits.loss_tokens)
        while n - at >= most:
            self._write([(key, ids, at, at + most, n, loss)])
            at += most
        if at < n:
            self._wait((key, ids[at:].copy(), at, n, loss))
        while len(self.pool) > self.POOL:
            self._step()

    def _wait(self, item: tuple) -> None:
        _, ids, start, _, loss = item
        self.demand[len(self.pool)] = len(ids), 1, len(ids) if loss is None else loss[start : start + len(ids)].sum()
        self.pool.append(item)

    def _step(self) -> None:
        d = self.demand[: len(self.pool)]
        fits = (d <= self.left).all(1)
        score = (d / self.caps) @ (self.left / self.caps)
        if fits.any():
            self._take(int(np.where(fits, score, -1).argmax()), None)
        elif (room := int(min(self.left[0], self.left[2]))) > 0 and self.left[1] >= 1:
            self._take(int(score.argmax()), room)
        else:
            self._close()

    def _take(self, k: int, room: int | None) -> None:
        need, (key, ids, start, total, loss) = self.demand[k].copy(), self.pool[k]
        last = self.pool.pop()
        if k < len(self.pool):
            self.pool[k], self.demand[k] = last, self.demand[len(self.pool)]
        part = ids if room is None else ids[:room]
        used = need[2] if room is None else len(part) if loss is None else int(loss[start : start + len(part)].sum())
        self.open.append((key, part, 0, len(part), total, loss, start))
        self.left -= (len(part), 1, used)
        if room is not None and room < len(ids):
            self._wait((key, ids[room:], start + room, total, loss))
        if self.left[0] < 1 or self.left[1] < 1 or self.left[2] < 1:
            self._close()

    def _close(self) -> None:
        segments, self.open, self.left = self.open, [], self.caps.copy()
        n = sum(s[3] - s[2] for s in segments)
        if n == self.limits.tokens or n & (n - 1) == 0:
            if segments:
                self._write(segments)
            return
        size = 1 << (n.bit_length() - 1)
        while segments:  # power-of-two sequences, the longest first
            taken, got = [], 0
            while got < size:
                key, ids, a, b, total, loss, start = segments.pop(0)
                cut = min(b, a + size - got)
                taken.append((key, ids, a, cut, total, loss, start))
                got += cut - a
                if cut < b:
                    segments.insert(0, (key, ids, cut, b, total, loss, start))
            self._write(taken)
            n -= size
            size = 1 << (n.bit_length() - 1) if n else 0

    def _write(self, segments: list[tuple]) -> None:
        offset = 0
        for key, ids, a, b, total, loss, *start in segments:
            at = a + (start[0] if start else 0)
            crc = zlib.crc32(ids[a:b].astype("<u4").tobytes())
            self.rows.append((key, at, b - a, crc, total, self.next_id, offset, b - a if loss is None else int(loss[at : at + b - a].sum())))
            offset += b - a
        self.next_id += 1

    def finish(self) -> None:
        while self.pool:
            self._step()
        self._close()


_ENCODERS: dict[str, Encoder] = {}


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, limits: Limits = Limits(), loss: str | None = None) -> DataFrame:
    """One row per piece of every document: ``doc_id`` and the columns of ``PIECES``.

    Null texts count as empty and become the end id alone. Repeated rows are
    packed one by one. Each input partition is packed by itself, without a
    shuffle, and leaves no padding; sequence ids hold the partition number in
    their upper bits. ``loss`` names a boolean column: the ids of its true rows
    bear loss, such as the answers of a conversation whose turns are the rows;
    without it every id does. Other columns are not returned.
    """
    schema = C.extended(docs.select("doc_id"), PIECES)

    def run(batches):
        from pyspark import TaskContext

        from .token_counts import tokenizer_path

        if tokenizer not in _ENCODERS:
            _ENCODERS[tokenizer] = Encoder(tokenizer_path(tokenizer))
        enc, packer = _ENCODERS[tokenizer], Packer(limits, TaskContext.get().partitionId() << 36)
        names = schema.names

        def rows() -> pd.DataFrame:
            out, packer.rows = pd.DataFrame(packer.rows, columns=names), []
            return out

        for pdf in C.slices(batches):
            for key, text, *bears in zip(*(pdf[c] for c in pdf)):
                ids = np.append(enc.encode(text if isinstance(text, str) else ""), np.int32(END_ID))
                packer.add(key, ids, np.full(len(ids), bool(bears[0])) if bears else None)
                if len(packer.rows) >= 20_000:
                    yield rows()
        packer.finish()
        yield rows()

    bears = [] if loss is None else [F.coalesce(F.col(loss), F.lit(False)).alias("bears")]
    return docs.select("doc_id", "text", *bears).mapInPandas(run, schema)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(C.read(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that are left."""
    return pack(docs)
