import pytest

from wakeline.llm.leakage import WuManber, aligned_span, search

ITEM = [f"w{i}" for i in range(40)]


@pytest.mark.parametrize(
    "first,n,changed,missing,want",
    [(5, 14, [2], [], 14), (5, 14, [11], [], 14), (0, 16, [1], [14], 16), (24, 16, [1, 3], [], 16), (3, 20, [], [2, 17], 20), (5, 14, [2, 9], [], 11), (5, 13, [], [], 13)],
)
def test_edits_anywhere_in_the_stretch(first, n, changed, missing, want):
    part = ITEM[first : first + n]
    for k in changed:
        part[k] = "other"
    doc = ["x"] * 30 + [w for k, w in enumerate(part) if k not in missing] + ["y"] * 30
    assert aligned_span(doc, ITEM) == want
    assert search(" ".join(doc), WuManber([(1, ITEM)])) == {1: want}


def test_added_words_and_repeats():
    doc = ITEM[:8] + ["more"] + ITEM[8:16] + ["x"] * 5 + ITEM[:9]
    assert aligned_span(doc, ITEM) == 16
