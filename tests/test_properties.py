"""Invariants over generated cases."""

import random

from docengine.operators import layout
from docengine.sources import ooxml, pdf, writers
from docengine.streaming import logs
from hypothesis import given, settings
from hypothesis import strategies as st

merges = st.lists(st.tuples(st.integers(0, 39), st.integers(1, 9)), max_size=4)


@given(st.integers(1, 40), merges, st.integers(1, 15))
def test_pages_cover_all_rows_and_cut_no_merge(n, ms, most):
    ms = [(t, min(h, n - t)) for t, h in ms if t < n]
    pages = layout.merge_pages([1] * n, ms, most)
    assert [a for a, _ in pages] == [0, *[b for _, b in pages[:-1]]] and pages[-1][1] == n
    for t, h in ms:
        assert any(a <= t and t + h <= b for a, b in pages)
    assert not ms and all(b - a <= most for a, b in pages) or ms or n == 0


@given(st.lists(st.integers(0, 500), min_size=1, max_size=20), st.integers(0, 5000))
def test_deficits_are_spread_whole(heights, need):
    out = layout.spread_deficit(heights, need)
    assert sum(out) == max(need, sum(heights)) and all(b >= a for a, b in zip(heights, out))


@given(st.integers(1, 16384))
def test_columns_round_trip(n):
    assert ooxml.letters_number(writers.column(n)) == n and ooxml.ref_at(f"{writers.column(n)}7") == (7, n)


@settings(deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_categories=["C", "Z"]), min_size=1, max_size=12), max_size=60))
def test_pdf_keeps_every_line(lines):
    lines = [x for x in lines if all(ord(c) < 0x10000 for c in x)]
    assert pdf.text_lines(writers.pdf(lines)) == list(dict.fromkeys(lines))


@settings(deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_categories=["C"], exclude_characters="\x85"), min_size=1, max_size=20), min_size=1, max_size=10))
def test_word_keeps_every_paragraph(texts):
    texts = [" ".join(t.split()) for t in texts if t.split()]
    got = [r[3] for r in ooxml.docx_blocks("d.docx", writers.docx([{"text": t, "level": 0} for t in texts]))]
    assert got == texts or not texts


@given(st.lists(st.tuples(st.integers(1, 9), st.sampled_from(["处理中", "已暂停", *logs.TERMINAL]), st.integers(0, 100)), max_size=9), st.integers(0, 9))
def test_states_settle_alike_in_any_order(events, seed):
    shuffled = events + events[: len(events) // 2]
    random.Random(seed).shuffle(shuffled)
    assert logs.settle("待处理", 0, events) == logs.settle("待处理", 0, shuffled)
    status, progress, _ = logs.settle("待处理", 0, events)
    assert logs.settle(status, progress, [(10, "处理中", 0)])[1] >= progress
