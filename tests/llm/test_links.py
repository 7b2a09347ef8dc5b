"""The n-gram join counts every link, in small families and between blocks of large ones."""

from __future__ import annotations

from collections import Counter

import pytest

from scriptorium.llm import ngram_join
from test_operators import sets_by_words


def links_of(sets):
    near = lambda a, b: (n := len(a & b)) and 100 * n >= 75 * (len(a) + len(b) - n)
    return [sum(1 for j, b in enumerate(sets) if j != i and near(a, b)) for i, a in enumerate(sets)]


@pytest.mark.parametrize("which", ["odd", "none", "copies"])
@pytest.mark.parametrize("block", [1_000_000, 300])
def test_links_by_brute_force(which, block, request):
    docs = request.getfixturevalue(which)
    rows = docs.select("doc_id", "text").collect()
    want = Counter(zip([r.doc_id for r in rows], links_of(sets_by_words([r.text for r in rows])), strict=True))
    assert which == "none" or max(n for _, n in want) > 1
    found = ngram_join.ngram_join(docs, block_shingles=block, order_sample=1).collect()
    assert Counter((r.doc_id, r.n_links) for r in found) == want
