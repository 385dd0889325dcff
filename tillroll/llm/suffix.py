"""Operator 10 - suffix-array dedup by column-wise construction.

Byte strings of ``width`` bytes that start anywhere else are removed.  The
stretches of ``anchors`` settle the inside of repeats; the open ones - pieces of
documents of at most ``2 * width`` bytes, aligned on their anchor - are sorted
by the column-wise multi-document construction: round after round, from the last
column to the first, one symbol of every piece is inserted in front of its
suffix.  The order of the suffixes (the collection's Burrows-Wheeler transform
reads the next column in this order) and the common prefixes of neighbours are
updated from the previous round alone, by one stable pass over the symbols and
one range minimum per symbol.  A suffix whose common prefix with a neighbour
reaches ``width`` is a repeated string.

The number of rounds is bounded by ``2 * width``, not by the longest document,
because equal strings have equal anchors and so meet in the same column; the
state between rounds is one permutation and one prefix array of the bucket.

Special rows: null or empty text has no bytes; repeated rows and rows with null
ids are documents of their own; an empty table gives an empty result.  A text is
held whole by one task, with about 60 bytes of work space a byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import anchors as A
from tillroll.llm import common as C

WIDTH, SEED = 200, 80


def columnwise(pieces: list[bytes], column: np.ndarray, width: int) -> np.ndarray:
    """For each piece (its first byte stands in ``column``): which of its windows another piece has.

    Returns flags of all windows, piece after piece (a piece has len - width + 1).
    """
    size = np.array([len(p) for p in pieces])
    first, last = column, column + size  # columns [first, last)
    at = np.concatenate([[0], np.cumsum(size)])[:-1] - first  # + column: place in data
    data = np.frombuffer(b"".join(pieces), np.uint8)
    count = size - width + 1
    flags = np.zeros(int(count.sum()), bool)
    flag_at = np.concatenate([[0], np.cumsum(count)])[:-1] - first
    windows_end = first + count
    order, common = np.zeros(0, np.int64), np.zeros(0, np.int64)
    by_last = np.argsort(-last, kind="stable")
    entered = 0
    for c in range(int(last.max()) - 1, int(first.min()) - 1, -1):
        stay = first[order] <= c
        if not stay.all():  # pieces that ended: neighbours' common prefix is the least on the way
            head = np.flatnonzero(stay)
            common = np.minimum.reduceat(common[:head[-1] + 1], np.concatenate([[0], head[:-1] + 1])) if len(head) else common[:0]
            order = order[stay]
        upto = entered
        while upto < len(by_last) and last[by_last[upto]] > c:
            upto += 1
        if upto > entered:  # pieces whose last symbol stands here: empty suffixes come first
            order = np.concatenate([by_last[entered:upto], order])
            common = np.concatenate([np.zeros(upto - entered, np.int64), common])
            if len(common) > upto - entered:
                common[upto - entered] = 0
            entered = upto
        symbol = data[at[order] + c]
        new = np.argsort(symbol, kind="stable")
        ordered = symbol[new]
        head = C.run_starts(ordered)
        fresh = np.empty(len(new), np.int64)
        for a, b in zip(head.tolist(), [*head[1:].tolist(), len(new)]):
            fresh[a] = 0
            if b - a > 1:
                old = new[a:b]
                fresh[a + 1:b] = np.minimum.reduceat(common[:old[-1] + 1], old[:-1] + 1) + 1
        order, common = order[new], fresh
        ripe = (c < windows_end[order])
        if ripe.any():
            hit = common >= width
            hit[:-1] |= common[1:] >= width
            hit &= ripe
            flags[flag_at[order[hit]] + c] = True
    return flags


def _compare(width: int, seed: int):
    def run(table: pa.Table) -> pa.Table:
        d, t, lo, off, st = (table.column(n).to_numpy() for n in ("_d", "_t", "lo", "off", "st"))
        pieces = table.column("symbols").to_pylist()
        flags = columnwise(pieces, (width - seed) - off.astype(np.int64), width)
        count = np.array([len(p) for p in pieces]) - width + 1
        piece = np.repeat(np.arange(len(pieces)), count)
        place = C.ranges(lo.astype(np.int64), lo + count)
        keep = flags & (st[piece] == A.OPEN)
        piece, place = piece[keep], place[keep]
        head = C.run_starts(piece, place - np.arange(len(place)))
        tail = np.append(head[1:], len(place)) - 1 if len(head) else head
        return A.span_table(d[piece[head]], t[piece[head]], place[head], place[tail])
    return run


def _bytes(width: int):
    def payload(part, codes, roll, x, y):
        raw = part.tobytes()
        return [raw[a:b] for a, b in zip(x.tolist(), (y + width).tolist())]
    return payload


def _cut(width: int):
    def run(batches):
        for batch in batches:
            buf, offs = C.text_buffer(batch.column(2))
            cut, lo, hi = A.lists_of(batch.column(3), "lo", "hi")
            rows = []
            for r in range(batch.num_rows):
                text = buf[offs[r]:offs[r + 1]]
                gone = A.covered(len(text), lo[cut[r]:cut[r + 1]], hi[cut[r]:cut[r + 1]] + width)
                spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
                rows.append((len(text), int(gone.sum()), spans, text[~gone].tobytes()))
                if len(rows) == 500 or r == batch.num_rows - 1:
                    kinds = [pa.int64()] * 3 + [pa.binary()]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(r + 1 - len(rows), len(rows)),
                                                      *(pa.array(x, k) for x, k in zip(zip(*rows), kinds))],
                                                     names=["_d", "n_bytes", "n_removed", "n_spans", "kept"])
                    rows = []
    return run


def repeated_spans(docs: DataFrame, width: int = WIDTH, seed: int = SEED, **limits) -> DataFrame:
    """(_d, _t, spans): runs [lo, hi] of first bytes of strings that start anywhere else too."""
    return A.repeated_spans(docs, A.Windows(width, seed, A.byte_symbols, anywhere=True, **limits), _bytes(width),
                            _compare(width, seed), "suffix")


def suffix_dedup(docs: DataFrame, width: int = WIDTH, seed: int = SEED, **limits) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (the bytes left)."""
    return (A.with_spans(docs, repeated_spans(docs, width, seed, **limits))
            .mapInArrow(_cut(width), "_d long, n_bytes long, n_removed long, n_spans long, kept binary")
            .select(C.doc_id_of(), "n_bytes", "n_removed", "n_spans", "kept"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(C.documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
