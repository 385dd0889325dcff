"""Operator 7 - benchmark decontamination with a distributed positional inverted index.

``build_index`` stores, for every block of training documents, the block's
terms, their counts and their ascending token positions (postings).  The index
is partitioned by document, so building it moves no text, and a phrase is
looked up in every block on its own.  The phrases (windows of the test items) are cut on
the executors and stored in blocks of a bounded number; ``search`` takes one stored block
after the other, which the tasks read from the shared folder.  In an index block a phrase
with an absent term is dropped at once, the others start from the postings of
their rarest term in that block and intersect the offset-adjusted lists of the
next rarest, until all terms are in place.  With ``slop`` the match is by
proximity: every term within ``len - 1 + slop`` words of the rarest one, in any order.

Special rows: null or empty text has no words, a null or repeated ``item_id``
is the id '' or one item; an empty benchmark hits nothing; a very long item is several
query blocks; repeated document rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import common as C

WIDTH = 13
#: A document is contaminated if at least one word in this many is hit.
HIT_SHARE = 20
#: Bytes of test item text that one search holds (about; a window for each WINDOW_BYTES at most); a larger benchmark is searched in several.
QUERY_BYTES = 4 << 20
#: Bytes of text in a block of the index.
BLOCK_BYTES = 1 << 20
#: Separators of the contract after lower-casing: all ASCII but digits and letters.
SEPARATOR = np.ones(256, bool)
SEPARATOR[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

#: Bytes of test item text for each window of a query block.
WINDOW_BYTES = 8

INDEX = "d binary, t binary, first binary, terms binary, counts binary, postings binary"
BLOCKS = "number int, terms binary, sizes binary, places binary, phrases binary, owners binary, names array<string>"
HITS = "_d long, _t int, spans array<struct<lo: long, hi: long>>, items array<string>"


def _terms(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = C.lower_ascii(buf)
    starts, ends, first = C.word_spans(low, offs, SEPARATOR)
    return C.word_codes(low, starts, ends), first


def _index(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        d, t = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        buf, offs = C.text_buffer(batch.column(2))
        for i, j in C.steps(offs, BLOCK_BYTES):
            codes, first = _terms(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
            order = np.argsort(codes, kind="stable")
            head = C.run_starts(codes[order])
            row = (C.planes(d[i:j]), C.planes(t[i:j]), C.planes(first.astype(np.int64)), C.pack_keys(codes[order][head]),
                   C.planes(np.diff(np.append(head, len(order))).astype(np.int32)),
                   C.planes(np.diff(order, prepend=0).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row],
                                             names=[x.split()[0] for x in INDEX.split(", ")])


def build_index(docs: DataFrame) -> DataFrame:
    """Stored positional inverted index of all words of all texts, a row for each block of documents."""
    return C.stored(C.keyed(docs).mapInArrow(_index, INDEX), "postings")


@dataclass
class Phrases:
    """Distinct phrases of one query block: their terms (by length) and the items that hold them."""
    terms: np.ndarray  # distinct codes, ascending
    by_length: list[tuple[np.ndarray, np.ndarray]]  # (phrase x place -> number of the term, phrase numbers)
    names: np.ndarray
    cuts: np.ndarray  # the owners of phrase i are at cuts[i]..cuts[i + 1]
    owners: np.ndarray

    def items(self, phrases: np.ndarray) -> list[str]:
        """Ids of the items that hold one of the phrases."""
        return sorted(set(self.names[self.owners[C.ranges(self.cuts[phrases], self.cuts[phrases + 1])]].tolist()))


def windows(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, first word and words of each window; an item of fewer words than ``width`` is one window."""
    words = np.diff(first)
    count = np.where(words > 0, np.maximum(words - width + 1, 1), 0)
    return np.repeat(np.arange(len(words)), count), C.ranges(first[:-1], first[:-1] + count), np.repeat(np.minimum(words, width), count)


def _query_blocks(width: int, most: int):
    """Query blocks of up to ``most`` windows each."""
    def block(number, codes, names, item, start, size) -> pa.RecordBatch:
        key = C.Rolling(codes)(start, start + size)
        order = np.lexsort((item, key, size))
        key, item, start, size = key[order], item[order], start[order], size[order]
        head = C.run_starts(size, key)
        once = C.run_starts(size, key, item)
        phrase = np.searchsorted(head, once, "right") - 1
        terms, places = np.unique(codes[C.ranges(start[head], start[head] + size[head])], return_inverse=True)
        own, owner = np.unique(item[once], return_inverse=True)
        row = [number, *(x.tobytes() for x in (terms, size[head].astype(np.int32), places.astype(np.int32), phrase.astype(np.int32), owner.astype(np.int32))),
               [names[i] for i in own]]
        types = [pa.int32()] + [pa.binary()] * 5 + [pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=[x.split()[0] for x in BLOCKS.split(", ")])

    def run(batches):
        number = 0
        for batch in batches:
            names = batch.column(0).to_pylist()
            codes, first = _terms(*C.text_buffer(batch.column(1)))
            found = windows(first, width)
            for i in range(0, len(found[0]), most):
                yield block(number, codes, names, *(x[i:i + most] for x in found))
                number += 1
    return run


def query_blocks(items: DataFrame, width: int = WIDTH, block_bytes: int = QUERY_BYTES) -> DataFrame:
    """Stored query set: the items' distinct windows in blocks of a bounded number, made and kept by the executors."""
    C.ship(items.sparkSession)
    texts = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.coalesce("text", F.lit("")).alias("x"))
    size = C.scan_bytes(items)  # few small blocks, as each is a pass over the index
    if size is not None:
        texts = texts.coalesce(max(1, -(-size // block_bytes)))
    return C.stored(texts.mapInArrow(_query_blocks(width, max(1, block_bytes // WINDOW_BYTES)), BLOCKS), "queries")


def _load(path: str, number: int) -> Phrases:
    fs, name = C.file_system(path)
    row = pq.read_table(name, filesystem=fs, filters=[("number", "=", number)]).to_pylist()[0]
    size, places, phrase, owner = (np.frombuffer(row[c], np.int32).astype(np.int64) for c in ("sizes", "places", "phrases", "owners"))
    head = np.cumsum(size) - size
    by_length = []
    for n in np.unique(size):
        own = np.flatnonzero(size == n)
        by_length.append((places[head[own][:, None] + np.arange(n)], own))
    return Phrases(np.frombuffer(row["terms"], np.uint64), by_length, np.array(row["names"], object),
                   np.searchsorted(phrase, np.arange(len(size) + 1)), owner)


def _member(lists: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.searchsorted(lists, wanted)
    return (at < len(lists)) & (lists[np.minimum(at, len(lists) - 1)] == wanted)


def _matches(q: Phrases, terms, counts, postings, first, slop):
    """(phrase, first word, end) of each match in one index block."""
    n = int(first[-1]) + 1
    begin = np.concatenate([[0], np.cumsum(counts)])
    place = np.searchsorted(terms, q.terms)
    there = _member(terms, q.terms)
    place = np.where(there, place, 0)
    number = np.where(there, counts[place], 0)
    lists = np.repeat(np.arange(len(terms)), counts) * n + postings  # all lists, ascending
    for grid, own in q.by_length:
        size = grid.shape[1]
        live = np.flatnonzero((number[grid] > 0).all(1))
        if not len(live):
            continue
        order = np.argsort(number[grid[live]], axis=1, kind="stable")  # rarest term first
        rare = place[grid[live, order[:, 0]]]
        phrase = np.repeat(live, counts[rare])
        line = np.repeat(np.arange(len(live)), counts[rare])
        at = postings[C.ranges(begin[rare], begin[rare] + counts[rare])]
        if slop:
            reach = size - 1 + slop
            doc = np.searchsorted(first, at, "right") - 1
            low, high = np.maximum(at - reach, first[doc]), np.minimum(at + reach, first[doc + 1] - 1)
        else:
            low = at - order[line, 0]
            keep = low >= 0
            phrase, line, low = phrase[keep], line[keep], low[keep]
            doc = np.searchsorted(first, low, "right") - 1
            high = low + size - 1
            keep = high < first[doc + 1]
            phrase, line, low, high = phrase[keep], line[keep], low[keep], high[keep]
        for k in range(1, size):
            if not len(phrase):
                break
            offset = order[line, k]
            term = place[grid[phrase, offset]]
            if slop:
                near = np.searchsorted(lists, term * n + low)
                keep = (near < len(lists)) & (lists[np.minimum(near, len(lists) - 1)] <= term * n + high)
            else:
                keep = _member(lists, term * n + low + offset)
            phrase, line, low, high = phrase[keep], line[keep], low[keep], high[keep]
        if len(phrase):
            yield own[phrase], low, high + 1


def _search(path: str, number: int, slop: int):
    def run(batches):
        q = None
        for batch in batches:
            q = q or _load(path, number)
            for r in batch.to_pylist():
                first = C.from_planes(r["first"], np.int64)
                if not first[-1]:
                    continue
                d, t = C.from_planes(r["d"], np.int64), C.from_planes(r["t"], np.int32)
                counts = C.from_planes(r["counts"], np.int32).astype(np.int64)
                postings = np.cumsum(C.from_planes(r["postings"], np.int64))
                found = list(_matches(q, C.unpack_keys(r["terms"]), counts, postings, first, slop))
                if not found:
                    continue
                phrase, low, high = (np.concatenate(x) for x in zip(*found))
                order = np.argsort(low, kind="stable")
                phrase, low, high = phrase[order], low[order], high[order]
                doc = np.searchsorted(first, low, "right") - 1
                head = C.run_starts(doc)
                out = []
                for a, b in zip(head, [*head[1:], len(doc)]):
                    x = doc[a]
                    spans = [{"lo": int(p - first[x]), "hi": int(e - first[x])} for p, e in zip(low[a:b], high[a:b])]
                    out.append((d[x], t[x], spans, q.items(np.unique(phrase[a:b]))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, k) for v, k in zip(zip(*out), (
                        pa.int64(), pa.int32(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])), pa.list_(pa.string())))],
                    names=["_d", "_t", "spans", "items"])
    return run


def search(index: DataFrame, items: DataFrame, width: int = WIDTH, slop: int = 0,
           block_bytes: int = QUERY_BYTES) -> DataFrame:
    """(_d, _t, spans, items): documents with a match, the matched word ranges [lo, hi) and the items they are of."""
    spark = index.sparkSession
    found = spark.createDataFrame([], HITS)
    blocks = query_blocks(items, width, block_bytes)
    for r in blocks.select(F.input_file_name().alias("path"), "number").orderBy("path", "number").collect():  # names only, no texts
        found = found.unionByName(C.stored(index.mapInArrow(_search(r.path, r.number, slop), HITS), "hits"))
    return (found.groupBy("_d", "_t").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")))


def _sizes(batches):
    for batch in batches:
        for r in batch.to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(C.from_planes(r["d"], np.int64)), pa.array(C.from_planes(r["t"], np.int32)),
                                              pa.array(np.diff(C.from_planes(r["first"], np.int64)))], names=["_d", "_t", "n_words"])


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, slop: int = 0) -> DataFrame:
    """A row per document: _d, _t, n_words, n_hit, items (ids found), contaminated."""
    index = build_index(docs)
    hits = search(index, items, width, slop)
    n_hit = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
                        lambda a, x: F.struct((a.n + F.greatest(F.lit(0).cast("long"), x.hi - F.greatest(a.end, x.lo))).alias("n"),
                                              F.greatest(a.end, x.hi).alias("end")), lambda a: a.n)
    hits = hits.select("_d", "_t", n_hit.alias("n_hit"), "items")
    sizes = index.select("d", "t", "first").mapInArrow(_sizes, "_d long, _t int, n_words long")
    n = F.coalesce("n_hit", F.lit(0).cast("long"))
    return sizes.join(hits, ["_d", "_t"], "left").select(
        "_d", "_t", "n_words", n.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n > 0) & (n * HIT_SHARE >= F.col("n_words"))).alias("contaminated"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(C.doc_id_of(), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''),
       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''),
       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM bi),
di AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw)),
hits AS (SELECT r, i, n, item FROM (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM di) JOIN bw USING (n, win)),
cover AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hits) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN ids USING (r)
"""
