"""Removal of repeated substrings by distributed prefix doubling.

A 50-byte string is known by its anchor, the least by hash (then the first) of
its 24 prefixes of 27 bytes, so equal strings have equal anchors at equal
places. Only anchors are named, about one in twelve positions. An anchor
stands for the strings that start 0 to 23 bytes before it, all of which hold
its 27 bytes.

1. Anchors whose 27 bytes no other document has drop out. The batches send
   sorted hashes alone, as gaps; a shared hash never hides a difference, it
   only keeps an anchor in.
2. Of the others, those whose whole context (all bytes that their strings can
   reach, at most 73) a smaller document has are repeats altogether.
3. What is left, one row for each different context, goes through rounds of
   Spark aggregations and sort-merge joins. A row is a range of starts with the
   rank of the bytes that all its strings hold. A round cuts the ranges in
   parts, pairs the rank with the bytes that the parts hold besides (27 bytes
   grow to 39, 45, 48 and 50), and ranks the pairs anew. Pairs of one document
   and ranges that a smaller document holds whole drop out; after the last
   round a range is one 50-byte string.

Documents lie in batch files in the shared folder, and the batches take in what
each step has found.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm import _common as C

SPAN, FIRST = 50, 27
WINDOW = SPAN - FIRST + 1
#: Starts in a range, round by round; the first is a whole window.
WIDTHS = (WINDOW, 12, 6, 3, 1)
#: Text in a batch, and names where they meet, in bytes; a worker takes about twelve times the first.
BATCH_BYTES, MEET_BYTES = 10 << 20, 12 << 20
#: A name is hot with so many anchors in one batch or with so many batches; its contexts are dealt out one by one.
HOT_IN_BATCH, HOT_BATCHES = 64, 4096
#: Bits of a class's number in its batch, of a start in a range, and of a batch's number in its task.
CLASS_BITS, START_BITS, MADE_BITS = 26, 5, 10
_PLACE = 18
CHUNK = (1 << _PLACE) - 4 * SPAN
_R = 0x9E3779B97F4A7C15
_NO_ID = np.iinfo(np.int64).max
MESSAGE = "p long, batch long, names binary, rest binary"
ANSWER = "batch long, p long, bits binary, n long, kept long"
CLASS = "id long, doc long, rank long, left binary, right binary"
RESULT = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse."""
    if "r" not in _powers or len(_powers["r"]) < n:
        for name, base in (("r", _R), ("i", pow(_R, -1, 1 << 64))):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["r"][:n], _powers["i"][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


class Batch:
    """The documents of a batch file, by id, as one run of bytes."""

    def __init__(self, path: str):
        fs, p = C.open_fs(path)
        with fs.open_input_stream(p, compression=None) as f:
            table = pa.ipc.open_stream(f.read()).read_all().combine_chunks()
        texts = table.column("text").combine_chunks()
        texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        self.starts, self.ends = offsets[:-1], offsets[1:]
        data = texts.buffers()[2]
        self.buf = np.frombuffer(data, np.uint8)[: offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
        # a missing id counts as larger than any
        self.rank = table.column("doc_id").fill_null(_NO_ID).to_numpy()

    def anchors(self, contexts: bool) -> tuple[np.ndarray, ...]:
        """For each run of strings with one anchor: the first start, the last start + 1, the anchor, its name and its context's name."""
        n = len(self.buf)
        end_of = np.repeat(self.ends, self.ends - self.starts)
        found: list[list[np.ndarray]] = [[], [], [], [], []]
        for s in range(0, max(0, n - SPAN + 1), CHUNK):
            e = min(s + CHUNK, n - SPAN + 1)
            lo, hi = max(0, s - WINDOW), min(n, e + SPAN + WINDOW)
            r, inv = _power((1 << _PLACE) + SPAN)
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum((self.buf[lo:hi].astype(np.uint64) + np.uint64(1)) * r[: hi - lo], out=sums[1:])
            at, k = s - lo, e - s + WINDOW - 1
            h = _mix((sums[at + FIRST : at + FIRST + k] - sums[at : at + k]) * inv[at : at + k])
            places = np.uint64((1 << _PLACE) - 1)
            least = _window_min((h & ~places) | np.arange(k, dtype=np.uint64), WINDOW) & places
            i = np.flatnonzero(np.arange(s, e) + SPAN <= end_of[s:e])
            if not len(i):
                continue
            a = least[i].astype(np.int64)
            new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (i[1:] != i[:-1] + 1)]))
            first, last = i[new] + s, i[np.concatenate([new[1:], [len(i)]]) - 1] + s + 1
            a = a[new]
            parts = [first, last, a + s, _mix(h[a])]
            a = a + s
            if contexts:
                doc = np.searchsorted(self.ends, first, side="right")
                left, right = np.maximum(self.starts[doc], a - WINDOW + 1), np.minimum(self.ends[doc], a + SPAN)
                parts.append(_mix((sums[right - lo] - sums[left - lo]) * inv[left - lo] + ((a - left) * 128 + (right - a)).astype(np.uint64)))
            else:
                parts.append(np.zeros(len(a), np.uint64))
            for x, v in zip(found, parts):
                x.append(v)
        first, last, a, name, context = (np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(found, (np.int64, np.int64, np.int64, np.uint64, np.uint64)))
        # a run that two chunks share is one run
        new = np.flatnonzero(np.concatenate([np.ones(min(1, len(a)), bool), (a[1:] != a[:-1]) | (first[1:] != last[:-1])]))
        return first[new], last[np.append(new, len(a))[1:] - 1], a[new], name[new], context[new]


def _groups_of(*keys: np.ndarray) -> np.ndarray:
    """Where groups begin in sorted keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _group_of_each(starts: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))


def _cut_bytes(v: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest needs, after a byte with their count."""
    width = max(1, (int(v.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _from_bytes(raw: bytes) -> np.ndarray:
    width = raw[0]
    out = np.zeros(((len(raw) - 1) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, width)
    return out.view("<u8").ravel()


def _gaps(v: np.ndarray) -> bytes:
    """Sorted numbers, at least one: the first, then the gaps."""
    return v[:1].astype("<u8").tobytes() + _cut_bytes(np.diff(v))


def _from_gaps(raw: bytes) -> np.ndarray:
    return np.cumsum(np.concatenate([np.frombuffer(raw, "<u8", 1), _from_bytes(raw[8:])]), dtype=np.uint64)


def _place(x: np.ndarray, groups: int) -> np.ndarray:
    """The meeting place of each 64-bit name; grows with the name."""
    return ((x >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)


def _bits(raw: bytes, rows: int, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=rows * n).reshape(rows, n).astype(bool)


def _answered(pdf: pd.DataFrame, rows: int) -> np.ndarray:
    """The bits for all that a batch sent, in the order of its places."""
    got = pdf[pdf["p"] >= 0].sort_values("p")
    return np.concatenate([_bits(b, rows, n) for b, n in zip(got["bits"], got["n"])], axis=1) if len(got) else np.zeros((rows, 0), bool)


def _known_names(name: np.ndarray, drop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, shortened sorted names, where each distinct one begins)."""
    short = name >> np.uint64(drop) << np.uint64(drop)
    order = np.argsort(short, kind="stable")
    short = short[order]
    return order, short, _groups_of(short)


def _send_names(groups: int, drop: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for number, path in zip(pdf["batch"], pdf["path"]):
                batch = Batch(path)
                first, _, _, name, _ = batch.anchors(False)
                order, short, starts = _known_names(name, drop)
                if not len(starts):
                    continue
                doc = batch.rank[np.searchsorted(batch.ends, first, side="right")][order]
                many = np.diff(np.append(starts, len(doc))) >= HOT_IN_BATCH
                several = np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)
                names = short[starts]
                p = _place(names, groups)
                cuts = _groups_of(p)
                ends = np.append(cuts[1:], len(p))
                names >>= np.uint64(drop)
                flags = [np.packbits(np.stack([several[a:b], many[a:b]])).tobytes() for a, b in zip(cuts, ends)]
                yield pd.DataFrame({"p": p[cuts], "batch": number, "names": [_gaps(names[a:b]) for a, b in zip(cuts, ends)], "rest": flags})

    return run


def _meet_names(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each name two bits: several documents have it; it is hot."""
    each = [_from_gaps(v) for v in pdf["names"]]
    sizes = np.array([len(v) for v in each])
    names = np.concatenate(each)
    several, many = np.concatenate([_bits(b, 2, n) for b, n in zip(pdf["rest"], sizes)], axis=1)
    order = np.argsort(names, kind="stable")
    starts = _groups_of(names[order])
    group = _group_of_each(starts, len(order))
    n = np.diff(np.append(starts, len(order)))
    out = np.zeros((2, len(order)), bool)
    out[0, order] = ((n > 1) | np.logical_or.reduceat(several[order], starts))[group]
    out[1, order] = ((n > HOT_BATCHES) | np.logical_or.reduceat(many[order], starts))[group]
    each = [out[:, b - k : b] for b, k in zip(np.cumsum(sizes), sizes)]
    return pd.DataFrame({"batch": pdf["batch"], "p": pdf["p"], "bits": [np.packbits(x).tobytes() for x in each], "n": sizes, "kept": [int(x[0].sum()) for x in each]})


def _state(path: str) -> str:
    return f"{path}.state"


def _send_contexts(groups: int, drop: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        path, number = pdf["path"].dropna().iloc[0], pdf["batch"].iloc[0]
        batch = Batch(path)
        first, last, a, name, context = batch.anchors(True)
        order, _, starts = _known_names(name, drop)
        shared, hot = _answered(pdf, 2)
        group = _group_of_each(starts, len(order))
        kept, is_hot = np.zeros(len(order), bool), np.zeros(len(order), bool)
        kept[order], is_hot[order] = shared[group], hot[group]
        first, last, a, name, context, is_hot = (v[kept] for v in (first, last, a, name, context, is_hot))
        rank = batch.rank[np.searchsorted(batch.ends, first, side="right")]
        p = _place(np.where(is_hot, _mix(name ^ _mix(context)), name), groups)
        order = np.lexsort((rank, context, name, p))
        name, context, p = name[order], context[order], p[order]
        starts = _groups_of(p, name, context)
        entry = np.zeros(len(order), np.int64)
        entry[order] = _group_of_each(starts, len(order))
        name, context, p, least, is_hot = name[starts], context[starts], p[starts], rank[order][starts], is_hot[order][starts]
        out = io.BytesIO()
        runs = {"gap": np.diff(first, prepend=0).astype(np.uint32), "size": (last - first).astype(np.uint8), "before": (a - first).astype(np.uint8)}
        np.savez_compressed(out, **runs, entry=entry.astype(np.uint32), hot=np.packbits(is_hot), entries=len(starts))
        fs, q = C.open_fs(_state(path))
        C.put(fs, q, out.getvalue())
        cuts = _groups_of(p)
        ends = np.append(cuts[1:], len(p))
        name >>= np.uint64(16)
        base = int(least.min(initial=_NO_ID))
        docs = [least[x:y] - base for x, y in zip(cuts, ends)]
        rest = [context[x:y].tobytes() + np.array([base], "<i8").tobytes() + _cut_bytes(d) for x, y, d in zip(cuts, ends, docs)]
        return pd.DataFrame({"p": p[cuts], "batch": number, "names": [_gaps(name[x:y]) for x, y in zip(cuts, ends)], "rest": rest})

    return run


def _meet_contexts(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each name and context two bits: a smaller document has them; no smaller one has, but some of the name's strings aren't decided by whole contexts."""
    names = [_from_gaps(v) for v in pdf["names"]]
    sizes = np.array([len(v) for v in names])
    name = np.concatenate(names)
    context = np.concatenate([np.frombuffer(r, "<u8", n) for r, n in zip(pdf["rest"], sizes)])
    doc = np.concatenate([_from_bytes(r[8 * n + 8 :]).astype(np.int64) + np.frombuffer(r, "<i8", 1, 8 * n) for r, n in zip(pdf["rest"], sizes)])
    order = np.lexsort((doc, context, name))
    name, context, doc = name[order], context[order], doc[order]
    of_name, of_both = _groups_of(name), _groups_of(name, context)
    in_name, in_both = _group_of_each(of_name, len(doc)), _group_of_each(of_both, len(doc))
    smaller = doc > doc[of_both][in_both]
    undecided = ~smaller & (doc > np.minimum.reduceat(doc, of_name)[in_name])
    opened = np.logical_or.reduceat(undecided, of_name)[in_name] & ~smaller
    out = np.zeros((2, len(doc)), bool)
    out[0, order], out[1, order] = smaller, opened
    ends = np.cumsum(sizes)
    return pd.DataFrame({"batch": pdf["batch"], "p": pdf["p"], "bits": [np.packbits(out[:, b - n : b]).tobytes() for b, n in zip(ends, sizes)], "n": sizes, "kept": 0})


class Decided:
    """A batch's runs after the contexts have met: those that are repeats, and those that stand for a class."""

    def __init__(self, batch: Batch, path: str, pdf: pd.DataFrame):
        fs, q = C.open_fs(_state(path))
        with fs.open_input_stream(q, compression=None) as f:
            s = np.load(io.BytesIO(f.read()))
        smaller, opened = _answered(pdf, 2)
        opened |= np.unpackbits(s["hot"], count=int(s["entries"])).astype(bool) & ~smaller
        self.first = np.cumsum(s["gap"].astype(np.int64))
        self.last, self.anchor = self.first + s["size"], self.first + s["before"]
        entry = s["entry"].astype(np.int64)
        self.rank = batch.rank[np.searchsorted(batch.ends, self.first, side="right")]
        least = np.full(int(s["entries"]), _NO_ID)
        np.minimum.at(least, entry, self.rank)
        self.known = smaller[entry] | (self.rank > least[entry])
        #: number of the class that a run stands for, or -1
        number = np.where(opened, np.cumsum(opened) - 1, -1)
        if opened.sum() >> CLASS_BITS:
            raise ValueError(f"a batch with more than 2**{CLASS_BITS} classes; store it in smaller batches")
        self.of = np.where(self.known, -1, number[entry])


def _classes(pdf: pd.DataFrame) -> pd.DataFrame:
    path, number = pdf["path"].dropna().iloc[0], int(pdf["batch"].iloc[0])
    batch = Batch(path)
    d = Decided(batch, path, pdf)
    some = np.flatnonzero(d.of >= 0)
    _, one = np.unique(d.of[some], return_index=True)
    at = some[one]
    text, first, a, end = batch.buf.tobytes(), d.first[at].tolist(), d.anchor[at].tolist(), (d.last[at] + SPAN - 1).tolist()
    word = np.zeros(len(at), np.uint64)
    for k in range(FIRST):
        word = word * np.uint64(_R) + batch.buf[d.anchor[at] + k]
    return pd.DataFrame({
        "id": (number << CLASS_BITS | d.of[at]) << START_BITS, "doc": d.rank[at], "rank": _mix(word).view(np.int64),
        "left": [text[x:y] for x, y in zip(first, a)], "right": [text[x + FIRST : y] for x, y in zip(a, end)],
    })


def _remove(pdf: pd.DataFrame, fates: pd.DataFrame) -> pd.DataFrame:
    path = pdf["path"].dropna().iloc[0]
    batch = Batch(path)
    d = Decided(batch, path, pdf)
    masks = np.zeros(int(d.of.max(initial=-1)) + 1, np.int64)
    masks[fates["class"].to_numpy(np.int64)] = fates["mask"].to_numpy(np.int64)
    own = np.flatnonzero(d.of >= 0)
    own = own[masks[d.of[own]] != 0] if len(own) else own
    mask = masks[d.of[own]]
    single = np.concatenate([np.zeros(0, np.int64), *((d.anchor[own] - k)[(mask >> k & 1 > 0) & (d.anchor[own] - k >= d.first[own]) & (d.anchor[own] - k < d.last[own])] for k in range(WINDOW))])
    n = len(batch.buf)
    edge = np.bincount(np.concatenate([d.first[d.known], single]), minlength=n + 1) - np.bincount(np.concatenate([d.last[d.known] + SPAN - 1, single + SPAN]), minlength=n + 1)
    gone = np.cumsum(edge[:n]) > 0
    rows = []
    for i, a, b in zip(batch.rank, batch.starts, batch.ends):
        g = gone[a:b]
        flips = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).view(np.int8)))
        rows.append((None if i == _NO_ID else i, b - a, [{"start": int(s), "end": int(e)} for s, e in zip(flips[::2], flips[1::2])], batch.buf[a:b][~g].tobytes()))
    out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "spans", "kept"])
    out["doc_id"] = pd.array([r[0] for r in rows], "Int64")
    return out


def _parts(items: DataFrame, width: int, part: int) -> DataFrame:
    """Ranges of `width` starts cut into ranges of `part`.

    left and right are the bytes before and after those that all strings of a
    range hold, as far as its strings reach; ext is what a part's strings hold
    more than the whole range's.
    """
    n_left, n_right = F.octet_length("left"), F.octet_length("right")
    some: list[Column] = []
    for j in range(width // part):
        before, after = j * part, width - (j + 1) * part
        left, right = F.substring("left", F.lit(1), n_left - before), F.substring("right", F.lit(after + 1), n_right - after)
        size = F.least(F.octet_length(left), F.lit(part - 1))
        new = F.struct(
            (F.col("id") + before).alias("id"),
            F.concat(F.lit(bytes([j])), F.substring("left", n_left - before + 1, F.lit(before)), F.substring("right", F.lit(1), F.lit(after))).alias("ext"),
            F.substring(left, F.octet_length(left) - size + 1, size).alias("left"),
            F.substring(right, F.lit(1), F.lit(part - 1)).alias("right"),
        )
        some.append(F.when((n_left >= before) & (n_right >= after), new))
    return items.select("doc", "rank", F.explode(F.array(*some)).alias("x")).filter("x is not null").select("doc", "rank", "x.*", F.xxhash64("x.left", "x.right").alias("rest"))


def _round(items: DataFrame) -> DataFrame:
    """Ranks the pairs (rank, ext); returns the ranges that are known as repeats or still open.

    A pair's new rank is the least id of its ranges, which no other pair has.
    A pair that one document has drops out. Minima are taken before the
    shuffle, and the join of the ranges with the table of pairs is one that
    adaptive execution splits, so a pair may belong to any share of the rows.
    """
    pairs = items.groupBy("rank", "ext").agg(
        F.min(F.struct("doc", "left", "right")).alias("best"), F.max("doc").alias("top"), F.min("id").alias("name"), F.min("rest").alias("least"), F.max("rest").alias("most")
    )
    pairs = C.cut(pairs.filter("top > best.doc").drop("top"), "doubling-pairs")
    C.free_shuffles(items.sparkSession)
    met = items.join(pairs, ["rank", "ext"])
    known = (F.col("doc") > F.col("best.doc")) & (F.col("left") == F.col("best.left")) & (F.col("right") == F.col("best.right"))
    return met.select("id", "doc", F.col("name").alias("rank"), "left", "right", known.alias("known"), (F.col("least") != F.col("most")).alias("differ")).filter("known or differ").drop("differ")


def doubled(classes: DataFrame) -> DataFrame:
    """(id of a class, mask): bit k is set when the string that starts k bytes before the class's anchor is in a smaller document."""
    items, fates = classes, None
    for width, part in zip(WIDTHS, WIDTHS[1:]):
        start = C.mark()
        met = _round(_parts(items, width, part))
        used = C.since(start)
        table = C.cut(met, "doubling")
        C.release(classes.sparkSession, used)
        mask = F.call_function("shiftleft", F.lit((1 << part) - 1).cast("long"), F.col("id").bitwiseAND((1 << START_BITS) - 1).cast("int"))
        own = table.filter("known").select(F.shiftright("id", START_BITS).alias("class"), mask.alias("mask"))
        items, fates = table.filter("not known"), own if fates is None else fates.unionByName(own)
        C.free_shuffles(classes.sparkSession)
    return fates.groupBy("class").agg(F.bit_or("mask").alias("mask"))


def _store(folder: str, batch_bytes: int):
    """Write the documents to batch files. A file's name is the attempt's own, and the list that Spark commits has one attempt's files only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = C.open_fs(folder)
        part, attempt, made, held, size = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], 0, [], 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as w:
                w.write_table(table)
            name = f"batch-{part:06d}-{made:04d}-{attempt}"
            C.put(fs, f"{top}/{name}", sink.getvalue())
            return pa.RecordBatch.from_arrays([pa.array([part << MADE_BITS | made], pa.int64()), pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64())], ["batch", "path", "size"])

        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).cast(pa.large_binary()).fill_null(b"")
            rows = pa.RecordBatch.from_arrays([batch.column(0), texts], ["doc_id", "text"])
            ends = np.cumsum(np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]))
            begin, before = 0, 0
            while begin < len(rows):
                # files of a long task grow, so that their numbers suffice
                room = (batch_bytes << made // 128) - size
                stop = min(len(rows), int(np.searchsorted(ends, before + room)) + 1)
                held.append(rows.slice(begin, stop - begin))
                size += int(ends[stop - 1]) - before
                begin, before = stop, int(ends[stop - 1])
                if size >= batch_bytes << made // 128:
                    yield flush()
                    made, held, size = made + 1, [], 0
        if held:
            yield flush()

    return run


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per input row: doc_id, n_bytes, spans (removed byte ranges), kept (the other bytes).

    A byte goes when a 50-byte string that covers it also starts in a document
    with a smaller id, as the input has it. Null texts are empty. A null id
    counts as larger than any; rows with one id are never each other's
    originals, so copies of a row fare alike. Texts under 50 bytes stay whole.
    An empty table gives an empty result. Other columns are not read. A batch
    holds at least one document, however long.
    """
    spark = docs.sparkSession
    C.small_batches(spark)
    folder = C.new_path(spark, "batches")
    ids_and_texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    stored = C.cut(ids_and_texts.mapInArrow(_store(folder, batch_bytes), "batch long, path string, size long"), "batch-list")
    total, files = stored.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    parts = C.parts_of(spark)
    wide = max(1, min(files, 8 * parts))
    anchors = total * 2 // (WINDOW + 1)
    # names keep so many bits that about one in 256 is shared by chance
    drop = 64 - min(64, max(40, int(anchors).bit_length() + 8))
    every = stored.select("batch", "path", F.lit(-1).cast("long").alias("p"), F.lit(b"").alias("bits"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("kept"))

    def by_batch(answers: DataFrame):
        # answers are small but each batch is work: dealt out by number, lest adaptive execution gathers them in a few tasks
        return answers.withColumn("path", F.lit(None).cast("string")).unionByName(every).repartition(wide, "batch").groupBy("batch")

    places = max(2 * parts, anchors * 4 // MEET_BYTES + 1)
    sent = stored.select("batch", "path").repartition(wide, "batch").mapInPandas(_send_names(places, drop), MESSAGE)
    start = C.mark()
    shared = C.cut(sent.groupBy("p").applyInPandas(_meet_names, ANSWER), "names-met")
    C.free_shuffles(spark)
    places = max(2 * parts, (shared.agg(F.sum("kept")).first()[0] or 0) * 16 // MEET_BYTES + 1)
    sent = by_batch(shared).applyInPandas(_send_contexts(places, drop), MESSAGE)
    done = C.since(start)
    met = C.cut(sent.groupBy("p").applyInPandas(_meet_contexts, ANSWER), "contexts-met")
    C.release(spark, done)
    C.free_shuffles(spark)
    classes = C.cut(by_batch(met).applyInPandas(_classes, CLASS), "classes")
    batch_of = F.shiftright("class", CLASS_BITS)
    fates = C.cut(doubled(classes).select(batch_of.alias("batch"), F.col("class").bitwiseAND((1 << CLASS_BITS) - 1).alias("class"), "mask"), "fates")
    return by_batch(met).cogroup(fates.repartition(wide, "batch").groupBy("batch")).applyInPandas(_remove, RESULT)
