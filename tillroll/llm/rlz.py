"""Operator 4 - substring dedup by relative Lempel-Ziv parsing.

The corpus is its own reference: every document is indexed as blocks (the
anchored stretches of ``anchors``), and every document is factored greedily
against the blocks of documents with smaller ids.  A block found whole in the
index is one long factor.  At the borders of such factors the blocks differ, so
they are parsed symbol by symbol: from each word the longest factor against all
reference blocks with the same anchor; windows that straddle a factor's border
are looked up on their own.  Factors of ``width`` words or more are duplicate
spans.

Result for special rows: null or empty text has no words; a null ``doc_id``
counts as the smallest; rows with equal ids are never earlier than each other,
so repeated rows keep their words alike; an empty table gives an empty result.
A text is held whole by one task, with about 40 bytes of work space a byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import anchors as A
from tillroll.llm import common as C

WIDTH, SEED = 50, 20


def factors(digests: np.ndarray, reference: dict) -> list[tuple[int, int]]:
    """Greedy parse of one block: maximal runs [i, j] of windows that the reference has."""
    out, i, n, own = [], 0, len(digests), digests.tolist()
    while i < n:
        if own[i] in reference:
            j = i
            while j + 1 < n and own[j + 1] in reference:  # the factor grows by a word, or the next one straddles its end
                j += 1
            out.append((i, j))
            i = j + 1
        else:
            i += 1
    return out


def _parse(table: pa.Table) -> pa.Table:
    """Blocks of one bucket: those of smaller ids are the reference of those that follow."""
    pk, d = (table.column(n).to_numpy() for n in ("pk", "_d"))
    t, lo = (table.column(n).to_numpy() for n in ("_t", "lo"))
    symbols = table.column("symbols").to_pylist()
    order = np.lexsort((d, pk))
    out, known, fresh, last = [], {}, [], (None, None)
    for i in order:
        if pk[i] != last[0]:
            known, fresh = {}, []
        elif d[i] != last[1]:
            for x in fresh:
                known.update(dict.fromkeys(x.tolist()))
            fresh = []
        last = (pk[i], d[i])
        digests = np.frombuffer(symbols[i], np.uint64)
        out += [(d[i], t[i], lo[i] + a, lo[i] + b) for a, b in factors(digests, known)] if known else []
        fresh.append(digests)
    return A.span_table(*(zip(*out) if out else ([], [], [], [])))


def _digests(width: int):
    def payload(part, codes, roll, x, y):
        at = C.ranges(x, y + 1)
        all_, cut = roll(at, at + width), np.concatenate([[0], np.cumsum(y + 1 - x)])
        return [all_[cut[i]:cut[i + 1]].tobytes() for i in range(len(x))]
    return payload


def _cut(width: int):
    def run(batches):
        for batch in batches:
            buf, offs = C.text_buffer(batch.column(2))
            cut, lo, hi = A.lists_of(batch.column(3), "lo", "hi")
            n_words, n_removed, kept = [], [], []
            for r in range(batch.num_rows):
                text = buf[offs[r]:offs[r + 1]]
                starts, ends, _ = C.word_spans(text, np.array([0, len(text)]), C.SPACE)
                gone = A.covered(len(starts), lo[cut[r]:cut[r + 1]], hi[cut[r]:cut[r + 1]] + width)
                raw = text.tobytes()
                kept.append(b" ".join([raw[a:b] for a, b in zip(starts[~gone].tolist(), ends[~gone].tolist())]).decode())
                n_words.append(len(starts))
                n_removed.append(int(gone.sum()))
                if len(kept) == 500 or r == batch.num_rows - 1:
                    at = r + 1 - len(kept)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(kept)), pa.array(n_words, pa.int64()),
                                                      pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                                                     names=["_d", "n_words", "n_removed", "kept"])
                    n_words, n_removed, kept = [], [], []
    return run


def duplicate_spans(docs: DataFrame, width: int = WIDTH, seed: int = SEED, **limits) -> DataFrame:
    """(_d, _t, spans): factors found in earlier documents, as runs [lo, hi] of window starts (words)."""
    return A.repeated_spans(docs, A.Windows(width, seed, A.word_symbols, anywhere=False, **limits),
                            _digests(width), _parse, "rlz")


def substring_dedup(docs: DataFrame, width: int = WIDTH, seed: int = SEED, **limits) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words left, joined by a space)."""
    return (A.with_spans(docs, duplicate_spans(docs, width, seed, **limits))
            .mapInArrow(_cut(width), "_d long, n_words long, n_removed long, kept string")
            .select(C.doc_id_of(), "n_words", "n_removed", "kept"))


def op4_rlz_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(C.documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
