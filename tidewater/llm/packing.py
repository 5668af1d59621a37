"""Packing tokenised documents into fixed windows by minimum bin slack."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm import _common as C

WINDOW, END_ID, CACHED = 1024, 0, 400_000
PIECE = "doc_id long, start long, length long, doc_tokens long, ids binary"
#: Unicode's White_Space, as the tokenizer's \s reads it.
_SPACE = r"\t-\r \x85\xa0  -     　"
_RUN = re.compile(f"[{_SPACE}][{_SPACE}]")
_CHUNK = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")


class Encoder(dict):
    """Ids of whole texts as little-endian 32-bit numbers, from a byte-level BPE file.

    The strings of the file's added tokens are cut out first and get their own
    ids, as the tokenizers library does unless told otherwise. No token of the
    rest spans the place where a run of white space begins, so it is encoded
    chunk by chunk and chunks are remembered, `room` at most: half of them are
    the latest, half older ones that come back when they are met. The merges
    run in tiktoken, whose ids are those of the tokenizers library for the
    same file.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            read = json.load(f)
        # byte-level alphabet: printable bytes stand for themselves, others follow from U+0100 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
        added = read.get("added_tokens", [])
        if any(x.get(k) for x in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that take in what stands around them aren't supported")
        self.added = {x["content"]: np.array([x["id"]], "<u4").tobytes() for x in added}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cuts = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None
        ranks = {bytes(byte_of[c] for c in w): i for w, i in read["model"]["vocab"].items() if w not in self.added}
        self.bpe = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.older: dict[str, bytes] = {}
        self.room = CACHED

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            ids = np.array(self.bpe.encode_ordinary(chunk), "<u4").tobytes()
        if len(chunk) < 64:
            if len(self) >= self.room // 2:
                self.older = dict(self)
                self.clear()
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if self.cuts is None or not self.cuts.search(text):
            return self.ordinary(text)
        return b"".join(self.added.get(part) or self.ordinary(part) for part in self.cuts.split(text))

    def ordinary(self, text: str) -> bytes:
        if _RUN.search(text):
            return b"".join(map(self.__getitem__, _CHUNK.findall(text)))
        first, *rest = text.split(" ")
        return self[first] + b"".join(map(self.__getitem__, [" " + w for w in rest])) if rest else self[first]


_encoders: dict[str, Encoder] = {}


def _cutter(path: str, pattern: str, window: int, cached: int):
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.setdefault(path, None) or Encoder(path, pattern)
        encoder.room, _encoders[path] = cached, encoder
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            size = 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.encode(text.as_py() or "") + end
                n = len(ids) // 4
                for start in range(0, n, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    for col, v in zip(out, (i, start, len(piece) // 4, n, piece)):
                        col.append(v)
                size += len(ids)
                if size > 8 << 20:
                    yield _batch(out)
                    out, size = [[], [], [], [], []], 0
            yield _batch(out)
        C.give_back()

    return run


def _batch(cols: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "start", "length", "doc_tokens", "ids"])


def tokenised_pieces(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", cached: int = CACHED) -> DataFrame:
    """Pieces of at most `window` ids, with their ids, of every row; a document ends with END_ID.

    Null text is empty: one piece with END_ID alone. Rows that repeat an id
    give their pieces each.
    """
    import public_tokenizers as P

    C.small_batches(docs.sparkSession)
    run = _cutter(tokenizer or P.path("byte_bpe_50k.json"), P.PATTERN, window, cached)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECE)


def bin_plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """Patterns [(length: copies), repeats] that use up all counts.

    Each pattern takes the longest remaining length; a bitset of subset sums
    over the others finds the fill closest to the window, read back to copies.
    A pattern repeats as often as the counts allow, so there are about as many
    patterns as lengths however many pieces there are.
    """
    left, plan = {k: v for k, v in counts.items() if v}, []
    while left:
        first = max(left)
        room = window - first
        left[first] -= 1
        reach, steps = 1, []
        for n in sorted((x for x in left if x <= room and left[x]), reverse=True):
            copies, unit = min(left[n], room // n), 1
            while copies:
                take = min(unit, copies)
                steps.append((n, take, reach))
                reach |= (reach << n * take) & ((2 << room) - 1)
                copies, unit = copies - take, unit * 2
            if reach >> room & 1:
                break
        at, pattern = reach.bit_length() - 1, {first: 1}
        for n, take, before in reversed(steps):
            if not before >> at & 1:
                at -= n * take
                pattern[n] = pattern.get(n, 0) + take
        left[first] += 1
        times = min(left[n] // k for n, k in pattern.items())
        for n, k in pattern.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        plan.append((pattern, times))
    return plan


def pack(pieces: DataFrame, window: int = WINDOW, order: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """pieces (column length, 1 to window, read twice) with sequence_id and offset.

    Only the counts of the at most `window` lengths reach the driver. Pieces
    of a length are numbered in salted groups, so that no length is one task's;
    the number gives the pattern, its repeat and the place in it.
    """
    buckets = max(64, C.parts_of(pieces.sparkSession))
    keyed = pieces.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    groups = C.cut(keyed.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_n")), "pack-counts")
    before = groups.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_b")) - F.col("_n")).drop("_n")
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    used: dict[int, int] = {}
    table: dict[int, list] = {}
    sequence = 0
    for pattern, times in bin_plan(counts, window):
        offset = 0
        for n, k in pattern.items():
            table.setdefault(n, []).append((used.get(n, 0), k, sequence, offset))
            used[n] = used.get(n, 0) + k * times
            offset += n * k
        sequence += times
    lookup = {n: np.array(rows, np.int64) for n, rows in table.items()}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seq, off = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            lengths, ranks = pdf["length"].to_numpy(), pdf["rank"].to_numpy()
            for n in np.unique(lengths):
                at = lengths == n
                rows, r = lookup[n], ranks[at]
                hit = rows[np.searchsorted(rows[:, 0], r, side="right") - 1]
                q = r - hit[:, 0]
                seq[at], off[at] = hit[:, 2] + q // hit[:, 1], hit[:, 3] + q % hit[:, 1] * n
            yield pd.DataFrame({"sequence_id": seq, "offset": off})

    def udf(length_rank: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return place(length_rank)

    udf.__annotations__ = {"length_rank": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    ranked = keyed.withColumn("_k", F.row_number().over(Window.partitionBy("length", "_b").orderBy(*order))).join(before, ["length", "_b"])
    placed = ranked.withColumn("_p", F.pandas_udf(udf, "sequence_id long, offset long")(F.struct(F.col("length"), (F.col("_before") + F.col("_k") - 1).alias("rank"))))
    return placed.select(*pieces.columns, "_p.sequence_id", "_p.offset")


def packed_documents(docs: DataFrame, window: int = WINDOW, cached: int = CACHED) -> DataFrame:
    """Pieces of all documents with their crc32, sequence and offset; `cached` chunks are remembered. An empty table gives an empty result."""
    pieces = tokenised_pieces(docs, window=window, cached=cached).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(C.cut(pieces, "pack-pieces"), window)
