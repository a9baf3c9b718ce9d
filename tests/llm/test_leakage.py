import random

from wakeline.llm.leakage import WuManber, aligned_span, found_leaks, item_passages, leaked_spans, search, words_of


def sentence(seed, n):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def test_found_leaks_with_noise_and_decoys(spark):
    shared = "Read the passage and answer in one short sentence please do it now and well."
    a, b = sentence(1, 40), sentence(2, 20)
    items = spark.createDataFrame([(1, f"{shared} {a}.", b), (2, f"{shared} {sentence(3, 30)}.", None), (3, None, None)], "item_id bigint, prompt string, answer string")
    w = a.split()
    changed = w[5:25]
    changed[7] = "other"
    del changed[14]
    docs = spark.createDataFrame(
        [(1, "x y z " + a.upper()), (2, "> **" + "**\n> ".join(changed) + "** end"), (3, " ".join(w[:9])), (4, shared), (5, None), (6, ""), (7, f"<p>{b}</p>"), (7, b), (8, "long " * 20_000 + b)],
        "doc_id bigint, text string",
    )
    assert sorted(tuple(r) for r in found_leaks(docs, items).collect()) == [(1, 1), (2, 1), (7, 1), (8, 1)]
    assert found_leaks(docs.limit(0), items).count() == 0 and found_leaks(docs, items.limit(0)).count() == 0


def test_words_and_shared_instructions():
    assert words_of("<b>It&#39;s</b> **LOW**-pressure\n(12)") == ["its", "low", "pressure", "12"]
    got = item_passages([(1, "Do this. Alpha beta.", None, ["Do this."]), (2, "Do this. Gamma.", "Delta", ["Do this."])])
    assert got == [(1, ["alpha", "beta"]), (2, ["gamma"]), (2, ["delta"])]


def test_span_counts_changed_words():
    item = [f"w{i}" for i in range(30)]
    doc = item[3:20]
    doc[8] = "z"
    assert aligned_span(doc, item) == 17
    assert aligned_span(["q"] * 10, item) == 0


def test_wording_that_several_items_share_is_found(spark):
    answer, passage = sentence(21, 20), sentence(22, 30)
    rows = [(i, f"{sentence(30 + i, 20)}.", answer) for i in (1, 2, 3)] + [(i, f"{passage}. {sentence(40 + i, 20)}.", None) for i in (4, 5)]
    items = spark.createDataFrame(rows, "item_id bigint, prompt string, answer string")
    docs = spark.createDataFrame([(1, f"so {answer} then"), (2, f"and {passage} too")], "doc_id bigint, text string")
    want = [(1, 1), (1, 2), (1, 3), (2, 4), (2, 5)]
    assert sorted(tuple(r) for r in found_leaks(docs, items).collect()) == want


def test_blocks_of_items_give_the_same(spark):
    items = [(i, f"{sentence(100 + i, 20)}.", None) for i in range(9)]
    docs = spark.createDataFrame([(i, p) for i, p, _ in items], "doc_id bigint, text string")
    known = spark.createDataFrame(items, "item_id bigint, prompt string, answer string")
    got = sorted((r["doc_id"], r["item_id"]) for r in leaked_spans(docs, known, block_items=4).collect())
    assert got == [(i, i) for i in range(9)]


def test_every_stretch_that_counts_holds_a_pattern():
    rnd = random.Random(4)
    for _ in range(300):
        n = rnd.randint(14, 48)
        item, doc = [f"w{i}" for i in range(n)], [f"w{i}" for i in range(n)]
        for k in rnd.sample(range(1, n - 1), n // 8):
            doc[k] = None if rnd.random() < 0.5 else "other"
        doc = ["x"] * 20 + [w for w in doc if w] + ["y"] * 20
        assert search(" ".join(doc), WuManber([(1, item)])) == {1: n}
    # edits side by side
    item = [f"w{i}" for i in range(40)]
    for first in range(1, 35):
        doc = ["x"] * 20 + item[:first] + ["other"] * 4 + item[first + 4 :] + ["y"] * 20
        assert search(" ".join(doc), WuManber([(1, item)])) == {1: 40}


def test_what_is_broadcast_needs_no_package():
    import pickle
    import pickletools

    raw = pickle.dumps(WuManber([(1, sentence(1, 20).split())]).tables())
    assert not any("wakeline" in str(arg) for _, arg, _ in pickletools.genops(raw))
