"""Decontamination against a scan of every document for every item."""

import random

import pytest

from mosaiq.llm import decontaminate as dc


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row
        row = [0]
        for j, y in enumerate(b):
            row.append(old[j] + 1 if x == y else max(old[j + 1], row[-1]))
    return row[-1]


def test_lcs():
    r = random.Random(1)
    for _ in range(300):
        a, b = ([bytes([97 + r.randrange(4)]) for _ in range(r.randrange(1, 20))] for _ in range(2))
        assert dc.lcs(dc.places(a), len(a), b) == plain_lcs(a, b)


def test_table(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {r.doc_id: set(map(int, filter(None, r.item_ids.split(",")))) for r in dc.contamination_digest(docs, bench).collect()}
    items = dc.read_items(bench)
    rows = [(r.doc_id, dc.tokens(r.text)) for r in docs.collect()]
    assert len(got) == len(rows)
    leaks = 0
    for i, words in rows:
        whole = b" " + b" ".join(words) + b" "
        inside = {x.item_id for x in items if x.joined in whole}
        leaks += len(inside)
        assert inside <= got[i]
        for x in (x for x in items if x.item_id in got[i] - inside):  # what else is found has enough words in order
            assert plain_lcs(x.words, words) >= 0.6 * len(x.words)
    assert leaks > 5


def test_paraphrases(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 9)))
    bench = [(k, " ".join(word() for _ in range(r.choice([15, 30, 59, 150]))) + ".") for k in range(30)]
    docs, want = [], {}
    for k in range(120):
        item, text = r.choice(bench)
        w = text[:-1].split()
        kind = k % 4
        if kind == 1:  # a tenth of the words is replaced
            for j in r.sample(range(len(w)), len(w) // 10):
                w[j] = word()
        elif kind == 2:  # a third but not the answer
            for j in r.sample(range(len(w) * 5 // 8), len(w) // 3):
                w[j] = word()
        elif kind == 3:  # half
            for j in r.sample(range(len(w)), len(w) // 2):
                w[j] = word()
        docs.append((k, " ".join([word() for _ in range(r.randrange(100))] + [x.upper() + "!!" for x in w] + [word() for _ in range(r.randrange(100))])))
        want[k] = str(item) if kind < 3 else ""
    docs += [(900, None), (901, ""), (901, ""), (None, bench[0][1]), (902, "the " * 30000 + bench[3][1])]
    want |= {900: "", 901: "", None: "0", 902: "3"}
    schema = "doc_id bigint, text string, best string"
    out = dc.contamination_digest(spark.createDataFrame([(i, t, "x") for i, t in docs], schema), spark.createDataFrame([*bench, (None, "x"), (77, None), (78, " ")], "item_id bigint, text string"))
    assert {r.doc_id: r.item_ids for r in out.collect()} == want


def test_short_items_among_other_words(spark):
    r = random.Random(8)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(600)]
    bench = [(k, " ".join(r.sample(vocab, r.choice([5, 8, 10, 15])))) for k in range(200)]
    docs = []
    for k in range(150):
        w = r.choice(bench)[1].split()
        if k % 2:  # as many words as an item may lack
            for j in r.sample(range(len(w)), len(w) // 5):
                w[j] = "none"
        docs.append((k, " ".join([r.choice(vocab) for _ in range(r.randrange(20, 90))] + w + [r.choice(vocab) for _ in range(r.randrange(20, 90))])))
    spaces = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(bench, "item_id bigint, text string")
    got = {(x.doc_id, int(i)) for x in dc.contamination_digest(*spaces).collect() for i in filter(None, x.item_ids.split(","))}
    items = dc.read_items(spaces[1])
    want = {(k, x.item_id) for k, t in docs for w in [dc.tokens(t)] for x in items if x.share(w, 0, len(w))}
    assert len(want) >= 150
    assert got == want


@pytest.mark.parametrize(("docs", "bench"), [([], [(1, "a b c d")]), ([(1, "a b c d")], [])])
def test_empty(spark, docs, bench):
    out = dc.contamination_digest(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(bench, "item_id bigint, text string")).collect()
    assert [(r.doc_id, r.contaminated) for r in out] == [(i, False) for i, _ in docs]


def synonym_tables(seed=3):
    """Facts whose words have two forms each; documents have a third of them in the second form, every third document out of order."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(7))
    facts = [[(word(), word()) for _ in range(r.choice([20, 36, 56]))] for _ in range(30)]
    common = [word() for _ in range(40)]
    corpus = [(k, " ".join(r.choice(c) for c in facts[k % 30])) for k in range(600)]
    corpus += [(2000 + k, " ".join(r.choice(common) for _ in range(60))) for k in range(60)]
    items = [(k, " ".join(a for a, _ in f)) for k, f in enumerate(facts)]
    items += [(100 + k, " ".join(b for _, b in r.sample(f, len(f)))) for k, f in enumerate(facts)]
    docs, want = [], {}
    for k in range(120):
        f = facts[k % 30]
        other = set(r.sample(range(len(f)), len(f) // 3))
        text = [c[j in other] for j, c in enumerate(f)]
        if k % 4 == 3:
            r.shuffle(text)
        # what stands beside it has words of other items too
        beside = [w for c in facts[(k + 7) % 30] + facts[(k + 13) % 30] for w in c]
        fill = [[r.choice(r.choice([common, beside])) for _ in range(r.randrange(60))] for _ in range(2)]
        docs.append((1000 + k, " ".join(fill[0] + text + fill[1])))
        want[1000 + k] = {k % 30} if k % 4 < 3 else set()
    return corpus, docs, items, want


def facts_of(found):
    return [set(x) & set(range(30)) for x in found]


def test_other_words_are_found_through_the_space(spark, monkeypatch):
    corpus, docs, items, want = synonym_tables()
    bench = dc.read_items(spark.createDataFrame(items, "item_id bigint, text string"))
    space = dc.fit_space(spark.createDataFrame(corpus + docs, "doc_id bigint, text string"), bench)
    texts, truth = [t for _, t in docs], [want[i] for i, _ in docs]
    got = facts_of(dc.search_texts(space, bench, texts))
    assert all(g <= t for g, t in zip(got, truth, strict=True))
    assert sum(map(len, got)) >= 0.9 * sum(map(len, truth))
    with monkeypatch.context() as m:  # every window against every item
        m.setattr(dc, "COSINE", -2.0)
        full = facts_of(dc.search_texts(space, bench, texts))
    assert all(g <= f for g, f in zip(got, full, strict=True))
    assert sum(map(len, got)) >= 0.9 * sum(map(len, full))
    space.basis[:], space.directions[:] = 0, 0
    blind = facts_of(dc.search_texts(space, bench, texts))  # only those with enough of the item's own words
    plain = [{x.item_id for x in bench if x.item_id < 30 and x.share(w, 0, len(w))} for w in map(dc.tokens, texts)]
    assert blind == plain
    assert sum(map(len, got)) >= 3 * sum(map(len, blind))


def test_places_in_long_and_empty_texts(spark):
    corpus, docs, items, want = synonym_tables()
    bench = dc.read_items(spark.createDataFrame(items, "item_id bigint, text string"))
    space = dc.fit_space(spark.createDataFrame(corpus + docs, "doc_id bigint, text string"), bench)
    alone = set(dc.search_texts(space, bench, [docs[0][1]])[0])
    assert alone >= want[1000]
    filler = "nothing " * (dc.SPAN * dc.BLOCK - 100)  # the passage stands across two spans
    together = dc.search_texts(space, bench, ["", docs[0][1], "", filler + docs[0][1], "x"])
    assert [set(x) for x in together] == [set(), alone, set(), alone, set()]
