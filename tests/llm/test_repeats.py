"""Operators 4 and 10 against brute force."""

from collections import Counter

import brute
import numpy as np
import pytest
from corpus_rows import edge_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillroll.llm import rlz, suffix


def rlz_rows(df, **limits):
    return Counter(map(tuple, rlz.substring_dedup(df, **limits).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()))


def suffix_rows(df, **limits):
    return Counter(map(tuple, suffix.suffix_dedup(df, **limits).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()))


def test_whole_table(spark, small):
    rows, sf = small
    assert Counter(map(tuple, rlz.op4_rlz_substring_dedup(spark, sf).collect())) == Counter(brute.substring_dedup(rows))
    assert Counter(map(tuple, suffix.op10_suffix_dedup(spark, sf).collect())) == Counter(brute.suffix_dedup(rows))


@pytest.mark.parametrize("limits", [{}, {"hot": 1, "flush": 1}])
def test_edges(edges, limits):
    """Nulls, empty and long texts, repeated rows; also with every key split and every task sending at once."""
    rows = [(d, t) for d, t, _ in edge_rows()]
    assert rlz_rows(edges, **limits) == Counter(brute.substring_dedup(rows))
    assert suffix_rows(edges, **limits) == Counter(brute.suffix_dedup(rows))


def test_empty(nothing):
    assert rlz.substring_dedup(nothing).count() == 0 and suffix.suffix_dedup(nothing).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.binary(min_size=4, max_size=9).map(lambda b: bytes(97 + x % 3 for x in b)), st.integers(0, 3)), min_size=2, max_size=9))
def test_columnwise_construction(pieces):
    """Flags of the construction equal a comparison of all windows that stand in one column."""
    width = 4
    text, column = [p for p, _ in pieces], np.array([c for _, c in pieces])
    flags = iter(suffix.columnwise(text, column, width))
    for i, p in enumerate(text):
        for s in range(len(p) - width + 1):
            c = column[i] + s
            same = any(j != i and 0 <= c - column[j] <= len(q) - width and q[c - column[j]:c - column[j] + width] == p[s:s + width]
                       for j, q in enumerate(text))
            assert next(flags) == same


def test_factors():
    known = dict.fromkeys([1, 2, 3, 9])
    assert rlz.factors(np.array([1, 2, 5, 3, 9, 9, 4], np.uint64), known) == [(0, 1), (3, 5)]
