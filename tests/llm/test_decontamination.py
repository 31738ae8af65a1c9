import random

import pytest

from tessella.llm import decontamination, queries

ITEMS = "item_id long, text string, cosine string"


def corpus(seed=1):
    rng = random.Random(seed)
    often = [f"the{i}" for i in range(30)]
    word = lambda: rng.choice(often) if rng.random() < 0.5 else f"v{rng.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(20, 60))).capitalize() + ". " + " ".join(word() for _ in range(10)) + ".", "") for i in range(60)]
    docs, truth = [], set()
    for d in range(400):
        text = [word() for _ in range(rng.randrange(5, 300))]
        if d % 8 == 0:
            i = rng.randrange(60)
            own = items[i][1].split()
            if d % 16 == 0:  # a paraphrase that keeps nine words of ten, in order
                own = [w if rng.random() < 0.9 else f"p{rng.randrange(9999)}" for w in own]
            at = rng.randrange(len(text))
            text[at:at] = [w.upper() if d % 24 == 0 else w for w in own]
            truth.add((d, i))
        docs.append((d, " ".join(text)))
    return items, docs, truth


def test_finds_copies_and_paraphrases_only(spark):
    items, docs, truth = corpus()
    out = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r.doc_id, r.item_id) for r in out} == truth
    text = dict(docs)
    assert all(0 <= r.first_word < r.end_word <= len(text[r.doc_id].split()) for r in out)


def test_blocks_of_items_give_the_same(spark):
    items, docs, truth = corpus(2)
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)
    out = [sorted(map(tuple, decontamination.contaminated(docs, items, block=n).collect())) for n in (25, 20000)]
    assert out[0] == out[1] and {r[:2] for r in out[0]} == truth


@pytest.mark.parametrize("share, least", [(0.1, 0.97), (0.2, 0.9), (0.25, 0.7)])
def test_paraphrases_with_synonyms(spark, share, least):
    """That share of an item's words is replaced, each by a synonym that other documents use in the same places."""
    rng = random.Random(8)
    items, docs, _ = corpus(3)
    docs = [(d, t) for d, t in docs if d % 8]
    synonym = lambda w: "syn" + w.lower().strip(".")
    docs += [(1000 + d, " ".join(synonym(w) if rng.random() < 0.5 else w for w in t.split())) for d, t in docs]
    truth = set()
    for i, text, _ in items:
        own = text.split()
        for k in rng.sample(range(len(own)), round(share * len(own))):
            own[k] = synonym(own[k])
        host = docs[i][1].split()
        host[len(host) // 2 : len(host) // 2] = own
        docs[i] = (docs[i][0], " ".join(host))
        truth.add((docs[i][0], i))
    out = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS))
    found = {(r.doc_id, r.item_id) for r in out.collect()}
    print("recall", share, len(found & truth) / len(truth), "others", len(found - truth))
    assert len(found & truth) >= least * len(truth) and not found - truth


def test_short_items_word_for_word(spark):
    docs = spark.createDataFrame([(1, "x y Alpha, BETA gamma. z"), (2, "alpha gamma beta"), (3, "alpha beta"), (4, "gamma delta")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "alpha beta gamma", ""), (8, "Éa", ""), (9, "", ""), (10, None, ""), (None, "alpha", "")], ITEMS)
    assert [(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items).collect()] == [(1, 7)]


def test_common_subsequence_against_plain_table():
    rng = random.Random(4)
    import numpy as np

    for _ in range(50):
        a, b = [[rng.randrange(6) for _ in range(rng.randrange(1, 20))] for _ in range(2)]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontamination.common(b, decontamination.bit_masks(np.array(a)), len(a)) == table[-1][-1]


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame(corpus()[0], ITEMS)
    assert decontamination.contaminated(odd, items).count() == 0
    assert decontamination.contaminated(none, items).count() == 0
    assert decontamination.contaminated(odd, items.limit(0)).count() == 0


def test_query_finds_every_verbatim_item(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    items = spark.read.parquet(f"{small}/benchmark.parquet").collect()
    truth = {(d.doc_id, i.item_id) for d in docs for i in items if i.text in (d.text or "")}
    assert truth <= {(r.doc_id, r.item_id) for r in queries.op8_latent_decontamination(spark, small).collect()}


def test_short_verbatim_items_of_a_large_benchmark(spark, small):
    """Items of 8 to 23 words cut from documents are found where they were cut, however many there are."""
    rng = random.Random(6)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect() if r.text and len(r.text.split()) >= 60]
    items, truth = [], set()
    for i in range(2000):
        doc, text = rng.choice(docs)
        text, size = text.split(), rng.randrange(8, 24)
        at = rng.randrange(len(text) - size)
        items.append((i, " ".join(text[at : at + size]), ""))
        truth.add((doc, i))
    out = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)).collect()
    assert truth <= {(r.doc_id, r.item_id) for r in out if r.lcs == 1}


def test_items_of_boilerplate_keep_a_run():
    import numpy as np

    same = [np.arange(12) for _ in range(100)]
    grams = decontamination.Grams([*same, np.arange(50, 53)])
    assert sorted(i for _, i, _ in grams.met(np.arange(12), np.array([0, 12]))) == list(range(100))
    assert grams.met(np.arange(12), np.array([0, 2, 4, 6, 8, 10, 12])) == []
    assert decontamination.Grams([]).met(np.arange(5), np.array([0, 5])) == []
