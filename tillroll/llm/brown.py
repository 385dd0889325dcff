"""Operator 2 - Brown class-based bigram language model.

Every word of the training texts has a class; a text's probability is a product
of class transitions and word emissions,
``P(w | v) = P(class(w) | class(v)) * P(w | class(w))``.

1. Texts are tokenised once into stored *blocks*: token numbers, and the block's
   sorted vocabulary with its training counts.
2. The counts of all words are exchanged by word; the most frequent words
   (``LEXICON``, a bound of the model) are the lexicon.  The bigram counts among
   them, summed over all blocks, are a table of bounded size, on which exchange
   clustering runs: word after word moves to the class that raises the class
   bigram likelihood most, until a sweep moves none.
3. One exchange step for all other words, distributed by word: from its counts
   beside lexicon classes over the whole corpus, each word takes its best class.
4. Classes and counts return to the blocks; transitions between classes are
   counted over all training tokens; every text is scored.

Counts are discounted absolutely in the emissions; the mass that this frees is
the probability of the unknown word, so the model is a distribution over the
V known words and one unknown, like the baseline.  Transitions are smoothed with
class frequencies.  The context after an unknown word is that of words seen once.

Special rows: null or empty text is one end token; a null ``doc_id`` is training
text; without training text every token has probability 1; repeated rows count
each; words are identified by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import common as C

LEXICON, CLASSES, SWEEPS = 1024, 64, 12
#: Classes beyond the exchanged ones: words without a lexicon neighbour, the end, and the contexts before a text and after an unknown word.
ALONE, END, START, UNKNOWN = CLASSES, CLASSES + 1, CLASSES + 2, CLASSES + 3
STATES = CLASSES + 4
DISCOUNT, PRIOR = 0.6, 20.0
BLOCK_BYTES = 8 << 20
END_CODE = np.uint64(0x9E3779B97F4A7C15)

BLOCKS = "d binary, t binary, held binary, first binary, ids binary, vocab binary, counts binary"


def _column(df_schema: str) -> list[str]:
    return [x.split()[0] for x in df_schema.split(", ")]


def _blocks(batches) -> Iterator[pa.RecordBatch]:
    def block(parts):
        d, t, held, size, codes = (np.concatenate(x) for x in zip(*parts))
        vocab, ids, every = np.unique(codes, return_inverse=True, return_counts=True)
        train = np.bincount(ids, weights=np.repeat(~held, size), minlength=len(vocab)).astype(np.int64)
        by_count = np.argsort(-every, kind="stable")  # frequent words have small numbers
        number = np.empty(len(vocab), np.int64)
        number[by_count] = np.arange(len(vocab))
        row = (C.planes(d), C.planes(t), held.tobytes(), C.planes(np.cumsum(size) - size), C.planes(number[ids].astype(np.int32)),
               C.pack_keys(vocab), C.planes(np.stack([train, number], 1).astype(np.int32).ravel()))
        return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], names=_column(BLOCKS))

    parts, size = [], 0
    for batch in batches:
        d, t, held = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
        buf, offs = C.text_buffer(batch.column(2))
        for i, j in C.steps(offs):
            low = C.lower_ascii(buf[offs[i]:offs[j]])
            starts, ends, first = C.word_spans(low, offs[i:j + 1] - offs[i], C.SPACE)
            codes = np.insert(C.word_codes(low, starts, ends), first[1:], END_CODE)
            parts.append((d[i:j], t[i:j], held[i:j], np.diff(first) + 1, codes))
            size += int(offs[j] - offs[i]) + j - i
            if size >= BLOCK_BYTES:
                yield block(parts)
                parts, size = [], 0
    if parts:
        yield block(parts)


class Block:
    """A stored block, unpacked: ``ids`` number the sorted ``vocab``."""

    def __init__(self, r: dict):
        self.name = r["block"]
        self.d, self.t = C.from_planes(r["d"], np.int64), C.from_planes(r["t"], np.int32)
        self.held = np.frombuffer(r["held"], bool)
        self.first = C.from_planes(r["first"], np.int64)
        self.vocab = C.unpack_keys(r["vocab"])
        self.train, number = C.from_planes(r["counts"], np.int32).reshape(-1, 2).T.astype(np.int64)
        back = np.empty(len(number), np.int64)
        back[number] = np.arange(len(number))
        self.ids = back[C.from_planes(r["ids"], np.int32)]

    def training_pairs(self) -> np.ndarray:
        """Token positions whose successor is in the same training text."""
        size = np.diff(np.append(self.first, len(self.ids)))
        ok = np.repeat(~self.held, size)
        ok[self.first + size - 1] = False
        return np.flatnonzero(ok)


def _send_counts(buckets: int):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                b = Block(r)
                out = [(x, C.pack_keys(k), C.planes(c[0].astype(np.int32))) for x, k, c in C.by_bucket(b.vocab, buckets, [b.train])]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary()))],
                                                 names=["bucket", "keys", "counts"])
    return run


def _top_words(most: int):
    def run(table: pa.Table) -> pa.Table:
        keys = np.concatenate([C.unpack_keys(x) for x in table.column("keys").to_pylist()])
        counts = np.concatenate([C.from_planes(x, np.int32) for x in table.column("counts").to_pylist()]).astype(np.int64)
        vocab, at = np.unique(keys, return_inverse=True)
        total = np.bincount(at, weights=counts).astype(np.int64)
        top = np.lexsort((vocab, -total))[:most]
        top = top[(total[top] > 0) & (vocab[top] != END_CODE)]
        return pa.table([vocab[top].view(np.int64), total[top]], names=["word", "n"])
    return run


def _in_lexicon(b: Block, lexicon: np.ndarray) -> np.ndarray:
    """Number in the (sorted) lexicon of each word of the block's vocabulary, or -1."""
    at = np.minimum(np.searchsorted(lexicon, b.vocab), max(len(lexicon) - 1, 0))
    return np.where(lexicon[at] == b.vocab, at, -1) if len(lexicon) else np.full(len(b.vocab), -1)


def _lexicon_pairs(lexicon: np.ndarray):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                b = Block(r)
                word = _in_lexicon(b, lexicon)[b.ids]
                at = b.training_pairs()
                u, v = word[at], word[at + 1]
                both = (u >= 0) & (v >= 0)
                pair, n = np.unique(u[both] * len(lexicon) + v[both], return_counts=True)
                home = pair // len(lexicon) % 32
                out = [(int(h), C.pack_keys(pair[home == h].astype(np.uint64)), C.planes(n[home == h].astype(np.int32))) for h in range(32)]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary()))],
                                                 names=["bucket", "keys", "counts"])
    return run


def _add_pairs(table: pa.Table) -> pa.Table:
    keys = np.concatenate([C.unpack_keys(x) for x in table.column("keys").to_pylist()])
    counts = np.concatenate([C.from_planes(x, np.int32) if x else np.zeros(0, np.int32) for x in table.column("counts").to_pylist()])
    pair, at = np.unique(keys, return_inverse=True)
    return pa.table([pa.array([C.pack_keys(pair)], pa.binary()), pa.array([C.planes(np.bincount(at, weights=counts, minlength=len(pair)).astype(np.int64))], pa.binary())],
                    names=["keys", "counts"])


def exchange(bigrams: np.ndarray, classes: int, sweeps: int) -> np.ndarray:
    """Exchange clustering of a (bounded) bigram table; words in descending frequency. Class of each word."""
    n = len(bigrams)
    k = min(classes, max(n, 1))
    cls = np.arange(n) % k
    member = np.zeros((n, k))
    member[np.arange(n), cls] = 1
    table = member.T @ bigrams @ member
    f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)
    for _ in range(sweeps):
        moved = 0
        for w in range(n):
            a, own = cls[w], bigrams[w, w]
            member[w, a] = 0
            right, left = bigrams[w] @ member, bigrams[:, w] @ member
            table[a] -= right
            table[:, a] -= left
            table[a, a] -= own
            rows, cols = table.sum(1), table.sum(0)
            diagonal = np.diag(table)
            gain = (f(table + right).sum(1) - f(table).sum(1) - f(diagonal + right) + f(diagonal)
                    + f(table.T + left).sum(1) - f(table.T).sum(1) - f(diagonal + left) + f(diagonal)
                    + f(diagonal + right + left + own) - f(diagonal)
                    - f(rows + right.sum() + own) + f(rows) - f(cols + left.sum() + own) + f(cols))
            b = int(np.argmax(gain + 1e-9 * (np.arange(k) == a)))
            table[b] += right
            table[:, b] += left
            table[b, b] += own
            member[w, b] = 1
            cls[w] = b
            moved += a != b
        if not moved:
            break
    return cls


def _transitions(table: np.ndarray) -> np.ndarray:
    """Smoothed P(column | row)."""
    prior = (table.sum(0) + 1.0) / (table.sum() + table.shape[1])
    return (table + PRIOR * prior) / (table.sum(1, keepdims=True) + PRIOR)


def _send_contexts(lexicon: np.ndarray, cls: np.ndarray, buckets: int):
    """Each word's training count in the block and its counts beside lexicon classes (left, then right)."""
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                b = Block(r)
                word = _in_lexicon(b, lexicon)
                kind = np.where(word >= 0, cls[word] if len(cls) else 0, -1)
                at = b.training_pairs()
                u, v = b.ids[at], b.ids[at + 1]
                left, right = kind[u] >= 0, kind[v] >= 0
                entry = np.concatenate([(v * 2 * CLASSES + kind[u])[left & (word[v] < 0)],
                                        (u * 2 * CLASSES + CLASSES + kind[v])[right & (word[u] < 0)]])
                entry, n = np.unique(entry, return_counts=True)
                owner = entry // (2 * CLASSES)
                cut = np.searchsorted(owner, np.arange(len(b.vocab) + 1))
                out, done = [], 0
                for x, k, c in C.by_bucket(b.vocab, buckets, [b.train]):
                    i, j = cut[done], cut[done + len(k)]
                    out.append((x, b.name, C.pack_keys(k), C.planes(c[0].astype(np.int32)), C.planes(np.diff(cut[done:done + len(k) + 1]).astype(np.int32)),
                                (entry[i:j] % (2 * CLASSES)).astype(np.uint8).tobytes(), C.planes(n[i:j].astype(np.int32))))
                    done += len(k)
                for i in range(0, len(out), 64):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, k) for x, k in zip(zip(*out[i:i + 64]), [pa.int32(), pa.int64()] + [pa.binary()] * 5)],
                        names=["bucket", "block", "keys", "counts", "sizes", "contexts", "n"])
    return run


def _planes_or_none(x: bytes, kind) -> np.ndarray:
    return C.from_planes(x, kind) if x else np.zeros(0, kind)


def _assign(lexicon: np.ndarray, cls: np.ndarray, table: np.ndarray):
    """Class and training count of every word of a bucket, sent back to the blocks that have it; class totals."""
    log = np.log(_transitions(table))
    weights = np.concatenate([log, log.T])  # context -> gain for each class: left ones P(c | context), right ones P(context | c)

    def run(tables: pa.Table) -> pa.Table:
        rows = tables.to_pylist()
        keys = [C.unpack_keys(r["keys"]) for r in rows]
        vocab, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([C.from_planes(r["counts"], np.int32) for r in rows])).astype(np.int64)
        owner = np.repeat(at, np.concatenate([C.from_planes(r["sizes"], np.int32) for r in rows]))
        context = np.concatenate([np.frombuffer(r["contexts"], np.uint8) for r in rows]).astype(np.int64)
        n = np.concatenate([_planes_or_none(r["n"], np.int32) for r in rows])
        pair, place = np.unique(owner * (2 * CLASSES) + context, return_inverse=True)
        n = np.bincount(place, weights=n) if len(pair) else np.zeros(0)
        owner, context = pair // (2 * CLASSES), pair % (2 * CLASSES)
        best = np.full(len(vocab), ALONE)
        head = C.run_starts(owner)
        for i in range(0, len(head), 4096):
            part = head[i:i + 4096]
            end = head[i + 4096] if i + 4096 < len(head) else len(owner)
            gain = np.add.reduceat(weights[context[part[0]:end]] * n[part[0]:end, None], part - part[0], axis=0)
            best[owner[part]] = np.argmax(gain, axis=1)
        if len(lexicon):
            place = np.minimum(np.searchsorted(lexicon, vocab), len(lexicon) - 1)
            fixed = lexicon[place] == vocab
            best[fixed] = cls[place[fixed]]
        best[vocab == END_CODE] = END
        known = total > 0
        best[~known] = UNKNOWN
        out, done = [], 0
        for r, k in zip(rows, keys):
            mine = at[done:done + len(k)]
            out.append((r["block"], r["bucket"], best[mine].astype(np.uint8).tobytes(), C.planes(total[mine]), None))
            done += len(k)
        sums = np.stack([np.bincount(best[known], minlength=STATES), np.bincount(best[known], weights=total[known], minlength=STATES)])
        out.append((None, None, None, None, sums.astype(np.int64).ravel().tolist()))
        return pa.table([pa.array(x, k) for x, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())))],
                        names=["block", "bucket", "cls", "total", "sums"])
    return run


SEQUENCES = "_d long, _t int, held boolean, n_tokens long, n_known long, base_score double, emission double, classes binary"


def _sequences(types: np.ndarray, tokens: np.ndarray):
    """Per text: baseline, log10 of its emissions, and its classes (words seen once keep theirs; a flag marks them)."""
    n_all, v_all = float(tokens.sum()), float(types.sum())

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                b = Block(r)
                parts = sorted(r["parts"], key=lambda x: x["bucket"])
                cls = np.concatenate([np.frombuffer(x["cls"], np.uint8) for x in parts]).astype(np.int64)
                total = np.concatenate([C.from_planes(x["total"], np.int64) for x in parts]).astype(float)
                known = total > 0
                emission = np.zeros(len(total))
                emission[known] = np.log10((total[known] - DISCOUNT) / tokens[cls[known]])
                emission[cls == END] = 0.0  # the end is the only word of its class
                base = np.log10((total + 0.5) / (n_all + 0.5 * (v_all + 1)))
                size = np.diff(np.append(b.first, len(b.ids)))
                add = lambda x: np.add.reduceat(x[b.ids], b.first)
                code = (cls + 128 * (total == 1))[b.ids].astype(np.uint8)
                cut = np.append(b.first, len(b.ids))
                out = (b.d, b.t, b.held, size, add(known.astype(np.int64)), add(base), add(emission),
                       [code[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:])])
                names = _column(SEQUENCES)
                kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=names)
    return run


def _class_pairs(classes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class before and class of each token, whether the word before was seen once, and each text's first token."""
    code, first = C.text_buffer(classes.cast(pa.large_binary()))
    code, first = code[first[0]:first[-1]], first - first[0]
    cls = (code & 127).astype(np.int64)
    before = np.empty_like(cls)
    before[1:] = cls[:-1]
    once = np.zeros(len(code), bool)
    once[1:] = code[:-1] >= 128
    before[first[:-1]] = START
    once[first[:-1]] = False
    return before, cls, once, first


def _count_transitions(batches) -> Iterator[pa.RecordBatch]:
    total = np.zeros(STATES * STATES, np.int64)
    for batch in batches:
        before, cls, once, _ = _class_pairs(batch.column(0))
        total += np.bincount(before * STATES + cls, minlength=STATES * STATES)
        total += np.bincount(UNKNOWN * STATES + cls[once], minlength=STATES * STATES)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])


def _score(log_p: np.ndarray):
    def run(batches):
        for batch in batches:
            before, cls, _, first = _class_pairs(batch.column(7))
            step = np.add.reduceat(log_p[before, cls], first[:-1])
            score = batch.column(6).to_numpy() + step
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 2, 3, 4, 5)), pa.array(score)],
                                             names=["_d", "held_out", "n_tokens", "n_known", "base_score", "score"])
    return run


def transition_logs(pairs: np.ndarray, types: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """log10 P(class | context); the unknown word's column has the mass that the discount frees."""
    p = _transitions(pairs[:, :END + 1].astype(float))
    free = np.divide(DISCOUNT * types[:END + 1], tokens[:END + 1], out=np.zeros(END + 1), where=tokens[:END + 1] > 0)
    free[END] = 0.0
    p[:, tokens[:END + 1] == 0] = 0.0  # classes without words
    p /= p.sum(1, keepdims=True)
    unknown = p @ free
    out = np.zeros((STATES, STATES))
    with np.errstate(divide="ignore"):
        out[:, :END + 1] = np.log10(p)
        out[:, UNKNOWN] = np.log10(np.maximum(unknown, 1e-12))
    return out


def score_texts(docs: DataFrame, held_out, lexicon_size: int = LEXICON, sweeps: int = SWEEPS) -> DataFrame:
    """A row per document: _d, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out`` is a boolean column of ``docs``; the model learns from the other rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    C.ship(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(C.NULL_ID)).alias("_d"), F.hash(text).alias("_t"),
                       text.alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    buckets = C.bucket_count(docs)
    # numbered as they are written: blocks that hold the same rows stay apart
    blocks = C.stored(rows.mapInArrow(_blocks, BLOCKS).withColumn("block", F.monotonically_increasing_id()), "lm-blocks")
    # the lexicon and its bigrams: tables bounded by lexicon_size
    top = (blocks.mapInArrow(_send_counts(buckets), "bucket int, keys binary, counts binary")
           .groupBy("bucket").applyInArrow(_top_words(lexicon_size), "word long, n long")
           .orderBy(F.col("n").desc(), "word").limit(lexicon_size).collect())
    by_count = np.array([r.word for r in top], np.int64).view(np.uint64)
    lexicon = np.sort(by_count)
    place = np.searchsorted(lexicon, by_count)
    size = len(lexicon)
    bigrams = np.zeros(size * size)
    if size:
        for r in (blocks.mapInArrow(_lexicon_pairs(lexicon), "bucket int, keys binary, counts binary")
                  .groupBy("bucket").applyInArrow(_add_pairs, "keys binary, counts binary").collect()):
            if r["keys"]:
                bigrams[C.unpack_keys(r["keys"]).astype(np.int64)] += C.from_planes(r["counts"], np.int64)
    bigrams = bigrams.reshape(size, size)
    cls = np.zeros(size, np.int64)
    cls[place] = exchange(bigrams[np.ix_(place, place)], CLASSES, sweeps)
    member = np.zeros((size, CLASSES))
    member[np.arange(size), cls] = 1
    # one exchange step for all words
    assigned = C.stored(blocks.mapInArrow(_send_contexts(lexicon, cls, buckets),
                                          "bucket int, block long, keys binary, counts binary, sizes binary, contexts binary, n binary")
                        .groupBy("bucket").applyInArrow(_assign(lexicon, cls, member.T @ bigrams @ member),
                                                        "block long, bucket int, cls binary, total binary, sums array<long>"), "lm-classes")
    sums = np.zeros(2 * STATES, np.int64)
    for r in (assigned.where("sums IS NOT NULL").select(F.posexplode("sums").alias("at", "n"))
              .groupBy("at").agg(F.sum("n").alias("n")).collect()):
        sums[r["at"]] = r["n"]
    types, tokens = sums.reshape(2, STATES)
    parts = assigned.where("block IS NOT NULL").groupBy("block").agg(F.collect_list(F.struct("bucket", "cls", "total")).alias("parts"))
    sequences = C.stored(blocks.join(parts, "block").mapInArrow(_sequences(types, tokens.astype(float)), SEQUENCES), "lm-sequences")
    pairs = np.zeros(STATES * STATES)
    for r in (sequences.where("NOT held").select("classes").mapInArrow(_count_transitions, "pair long, n long")
              .groupBy("pair").agg(F.sum("n").alias("n")).collect()):
        pairs[r["pair"]] = r["n"]
    logs = transition_logs(pairs.reshape(STATES, STATES), types.astype(float), tokens.astype(float))
    if not tokens.sum():
        logs[:] = 0.0
    return (sequences.mapInArrow(_score(logs), "_d long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
            .withColumn("train_tokens", F.lit(int(tokens.sum())).cast("long")))


def op2_brown_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.documents(spark, sf_dir)
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1
    return score_texts(docs, held_out).select(C.doc_id_of(), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
