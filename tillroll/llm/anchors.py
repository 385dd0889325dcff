"""Repeated windows of a corpus, found through anchors.

A *window* is ``width`` consecutive symbols (words or bytes) of one document.
Every window has an *anchor*: the position of its smallest seed hash (``seed``
symbols), leftmost on ties - a function of the window's content alone, so
equal windows have equal anchors at the same offset.  Consecutive windows with
one anchor form a *stretch*, and only stretches travel: one row for
``(width - seed) / 2`` symbols or so.

1. ``stretches_of`` (map): key = hash of the seed, ctx = hash of the whole
   stretch with the anchor's place in it.  Equal stretches inside one task are
   settled there and only one of them is sent, so a group of copies that holds
   a third of all rows arrives as one row per task.
2. ``judge`` (one exchange by key): a stretch that equals another as a whole is
   settled; one that shares its key with different stretches is *open*; a
   stretch alone with its key repeats nowhere.
3. The open stretches - the borders of repeats - fetch their symbols and are
   compared window by window by the operator's own method.  Keys with very many
   different stretches are split by half a window of context left or right of
   the anchor (every window contains one of the two whole).

Nothing is capped or sampled: each window is settled in step 2 or compared in
step 3.  Equality in step 2 is equality of two independent 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm import common as C

PLACE = np.uint64((1 << 28) - 1)
SETTLED, OPEN, WITNESS = 1, 0, 2

SENT = "bucket int, kind int, key binary, ctx binary, d binary, t binary, lo binary, span binary, off binary, n binary"
MARKS = "_d long, _t int, lo int, hi int, off int, st int, hot boolean"
PARTS = "bucket int, pk long, _d long, _t int, lo int, off int, st int, symbols binary"
SPANS = "_d long, _t int, lo int, hi int"
_SENT_TYPES = [pa.int32()] * 2 + [pa.binary()] * 8
_KEEP = [("d", np.int64), ("t", np.int32), ("lo", np.int32), ("span", np.int32), ("off", np.int32), ("n", np.uint8)]


@dataclass(frozen=True)
class Windows:
    """What a window is: ``codes`` turns texts into symbol hashes and each text's first symbol."""
    width: int
    seed: int
    codes: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    #: a window repeats if it starts anywhere else (True), or in a document with a smaller id (False)
    anywhere: bool
    #: stretches that a task gathers before it settles equal ones and sends the rest
    flush: int = 200_000
    #: different stretches of one key beyond which the key is split by context
    hot: int = 200


def byte_symbols(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return C.byte_codes(buf), offs


def word_symbols(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = C.word_spans(buf, offs, C.SPACE)
    return C.word_codes(buf, starts, ends), first


def _anchors(codes: np.ndarray, first: np.ndarray, w: Windows):
    """Row, first and last window, anchor, key and ctx of each stretch (positions within ``codes``)."""
    begin, end = first[:-1], np.maximum(first[:-1], first[1:] - w.width + 1)
    window = C.ranges(begin, end)
    if not len(window):
        return None
    roll = C.Rolling(codes)
    at = np.arange(len(codes) - w.seed + 1)
    seeds = roll(at, at + w.seed)
    least, reach = (seeds & ~PLACE) | at.astype(np.uint64), 1
    size = w.width - w.seed + 1
    while reach < size:  # minimum over ``reach`` positions, doubled until it spans the window
        step = min(reach, size - reach)
        least[:-step] = np.minimum(least[:-step], least[step:])
        reach += step
    place = (least[window] & PLACE).astype(np.int64)
    head = C.run_starts(place)
    lo, hi, a = window[head], window[np.append(head[1:], len(window)) - 1], place[head]
    row = np.searchsorted(first, lo, "right") - 1
    ctx = roll(lo, hi + w.width) ^ C.mix(((a - lo) << 32 | (a - hi)).astype(np.uint64))
    return row, lo, hi, a, C.mix(seeds[a]), ctx  # anchors have small hashes: mixed again, keys are spread evenly


def _heads(key, ctx):
    """Group number of each row of sorted (key, ctx) and each group's first row."""
    head = C.run_starts(key, ctx)
    group = np.zeros(len(key), np.int64)
    group[head[1:]] = 1
    return np.cumsum(group), head


def stretches_of(w: Windows, buckets: int):
    def send(kind, bucket, key, ctx, cols):
        return (bucket, kind, C.pack_keys(key), ctx.tobytes(), *(C.planes(c) for c in cols))

    def flush(rows: list) -> Iterator[pa.RecordBatch]:
        key, ctx, *cols = (np.concatenate(x) for x in zip(*rows))
        order = np.lexsort((cols[0], ctx, key))
        key, ctx, cols = key[order], ctx[order], [c[order] for c in cols]
        group, head = _heads(key, ctx)
        out = []
        if w.anywhere:
            many = np.diff(np.append(head, len(key))) > 1
            settled, go = many[group], np.zeros(len(key), bool)
            go[head] = True
            cols.append(np.where(many, 2, 1).astype(np.uint8)[group])
        else:
            settled = cols[0] > cols[0][head][group]
            go = ~settled
            cols.append(np.ones(len(key), np.uint8))
        if settled.any():
            some = [c[settled] for c in cols]
            out.append(send(1, int(C.mix(key[:1])[0] % np.uint64(buckets)), np.zeros(0, np.uint64), np.zeros(0, np.uint64), some))
        for bucket, k, rest in C.by_bucket(key[go], buckets, [ctx[go], *(c[go] for c in cols)]):
            out.append(send(0, bucket, k, rest[0], rest[1:]))
        for i in range(0, len(out), 64):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[i:i + 64]), _SENT_TYPES)],
                                             names=[x.split()[0] for x in SENT.split(", ")])

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            d, t = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            buf, offs = C.text_buffer(batch.column(2))
            for i, j in C.steps(offs):
                codes, first = w.codes(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
                found = _anchors(codes, first, w)
                if found is None:
                    continue
                row, lo, hi, a, key, ctx = found
                rows.append((key, ctx, d[i:j][row], t[i:j][row], (lo - first[row]).astype(np.int32),
                             (hi - lo).astype(np.int32), (a - lo).astype(np.int32)))
                held += len(key)
                if held >= w.flush:
                    yield from flush(rows)
                    rows, held = [], 0
        if rows:
            yield from flush(rows)
    return run


def judge(w: Windows):
    names = [x.split()[0] for x in MARKS.split(", ")]

    def marks(d, t, lo, span, off, st, hot):
        return pa.table([d, t, lo, lo + span, off, np.broadcast_to(np.int32(st), d.shape) if np.isscalar(st) else st, hot], names=names)

    def run(table: pa.Table) -> pa.Table:
        out, sent = [], {0: [], 1: []}
        for r in table.to_pylist():
            cols = [C.from_planes(r[n], kind) for n, kind in _KEEP]
            if r["kind"] == 0:
                cols += [C.unpack_keys(r["key"]), np.frombuffer(r["ctx"], np.uint64)]
            sent[r["kind"]].append(cols)
        if sent[1]:
            d, t, lo, span, off, _ = (np.concatenate(x) for x in zip(*sent[1]))
            out.append(marks(d, t, lo, span, off, SETTLED, np.zeros(len(d), bool)))
        if sent[0]:
            d, t, lo, span, off, n, key, ctx = (np.concatenate(x) for x in zip(*sent[0]))
            order = np.lexsort((d, ctx, key))
            d, t, lo, span, off, n, key, ctx = (x[order] for x in (d, t, lo, span, off, n, key, ctx))
            group, head = _heads(key, ctx)
            weight = np.add.reduceat(n.astype(np.int64), head)
            home = np.zeros(len(head), np.int64)  # the key's number, by group
            home[C.run_starts(key[head])[1:]] = 1
            home = np.cumsum(home)
            kinds = np.bincount(home)[home]  # different stretches of the group's key
            if w.anywhere:
                settled = (weight > 1)[group]
                alone = np.bincount(home, weights=weight == 1)[home] > 0  # the key has a stretch to judge
                first = np.zeros(len(d), bool)
                first[head] = True
                witness = settled & (kinds > 1)[group] & alone[group] & first
            else:
                settled = d > d[head][group]
                witness = np.zeros(len(d), bool)
            opened = ~settled & (kinds > 1)[group]
            hot = (kinds > w.hot)[group]
            for rows, st in ((settled, SETTLED), (opened, OPEN), (witness, WITNESS)):
                if rows.any():
                    out.append(marks(*(x[rows] for x in (d, t, lo, span, off)), st, hot[rows]))
        schema = pa.schema([("_d", pa.int64()), ("_t", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()),
                            ("off", pa.int32()), ("st", pa.int32()), ("hot", pa.bool_())])
        return pa.concat_tables([x.cast(schema) for x in out]) if out else schema.empty_table()
    return run


def lists_of(col, *fields) -> tuple[np.ndarray, ...]:
    """Offsets into, and the flattened int fields of, an array<struct> column (null: no element)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    size = np.nan_to_num(np.asarray(pc.list_value_length(col).to_numpy(zero_copy_only=False), float)).astype(np.int64)
    flat = col.flatten()
    return (np.concatenate([[0], np.cumsum(size)]),
            *(flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in fields))


def parts_of(w: Windows, buckets: int, payload: Callable):
    """Symbols of the open stretches, dealt by key (or key and half a window of context)."""
    names = [x.split()[0] for x in PARTS.split(", ")]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    half = w.width // 2

    def run(batches):
        for batch in batches:
            d, t = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            buf, offs = C.text_buffer(batch.column(2))
            cut, lo, hi, off, st, hot = lists_of(batch.column(3), "lo", "hi", "off", "st", "hot")
            for i, j in C.steps(offs):
                part = buf[offs[i]:offs[j]]
                codes, first = w.codes(part, offs[i:j + 1] - offs[i])
                roll = C.Rolling(codes)
                rows = np.arange(cut[i], cut[j])
                row = np.repeat(np.arange(i, j), np.diff(cut[i:j + 1]))
                base = first[row - i]
                b, e, o, s = base + lo[rows], base + hi[rows], off[rows], st[rows]
                a = b + o
                key = C.mix(roll(a, a + w.seed))
                split = hot[rows].astype(bool)
                left = split & (a - b >= half)
                right = split & (a - e < half)
                sets = [(~split, b, e, key)]
                if split.any():
                    n = len(codes)
                    sets.append((left, b, np.minimum(e, a - half), C.mix(key ^ roll(np.maximum(a - half, 0), a))))
                    sets.append((right, np.maximum(b, a - half + 1), e, C.mix(key + roll(a, np.minimum(a + half, n)))))
                for pick, x, y, pk in sets:
                    if not pick.any():
                        continue
                    x, y, pk, an, rw = x[pick], y[pick], pk[pick], a[pick], row[pick]
                    home = (((pk >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)
                    symbols = payload(part, codes, roll, x, y)
                    for p in range(0, len(x), 20_000):
                        q = slice(p, p + 20_000)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(v, ty) for v, ty in zip((home[q], pk[q].view(np.int64), d[rw[q]], t[rw[q]], x[q] - first[rw[q] - i],
                                                               an[q] - x[q], s[pick][q], symbols[q]), types)], names=names)
    return run


def repeated_spans(docs: DataFrame, w: Windows, payload: Callable, compare: Callable, name: str) -> DataFrame:
    """(_d, _t, spans): per document that has any, its runs [lo, hi] of repeated windows (first symbols)."""
    rows = C.keyed(docs)
    buckets = C.bucket_count(docs)
    marks = C.stored(rows.mapInArrow(stretches_of(w, buckets), SENT)
                     .groupBy("bucket").applyInArrow(judge(w), MARKS), f"{name}-marks")
    asked = (marks.where(F.col("st") != SETTLED).groupBy("_d", "_t")
             .agg(F.collect_list(F.struct("lo", "hi", "off", "st", "hot")).alias("asked")))
    found = (rows.join(asked, ["_d", "_t"]).select("_d", "_t", "text", "asked")
             .mapInArrow(parts_of(w, buckets, payload), PARTS)
             .groupBy("bucket").applyInArrow(compare, SPANS))
    return (marks.where(F.col("st") == SETTLED).select("_d", "_t", "lo", "hi").unionByName(found)
            .groupBy("_d", "_t").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")))


def span_table(d, t, lo, hi) -> pa.Table:
    return pa.table([pa.array(d, pa.int64()), pa.array(t, pa.int32()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())],
                    names=["_d", "_t", "lo", "hi"])


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Every document row with its spans (null: none)."""
    return C.keyed(docs).join(spans, ["_d", "_t"], "left").select("_d", "_t", "text", "spans")


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n symbols lie in any [start, end)."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, start, 1)
    np.add.at(depth, end, -1)
    return np.cumsum(depth[:-1]) > 0
