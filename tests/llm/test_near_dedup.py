import random

import pytest

from tessella.llm import near_dedup, queries


def plain(rows, size, percent):
    """Components by comparing all pairs of sets of shingles."""
    sets = {}
    for i, text in rows:
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
        sets[i] = {tuple(raw[j : j + size]) for j in range(len(raw) - size + 1)} if len(raw) >= size else ({tuple(raw)} if raw else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, groups, copies, words, edits):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(words)]
        for _ in range(copies):
            one = list(base)
            for _ in range(rng.randrange(edits + 1)):
                one[rng.randrange(words)] = f"e{rng.randrange(100000)}"
            rows.append(" ".join(one) if rng.random() < 0.8 else " ".join(one).upper())
    rng.shuffle(rows)
    return [(100 + i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("size, rows", [(2, corpus(1, 8, 8, 60, 8)), (5, corpus(2, 4, 10, 120, 5)), (2, corpus(3, 1, 260, 60, 9))])
def test_equals_all_pairs(spark, size, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size, 80).collect()}
    assert got == plain(rows, size, 80)


@pytest.mark.parametrize("edits", [9, 14])
def test_large_buckets_are_compared_in_blocks(spark, monkeypatch, edits):
    monkeypatch.setattr(near_dedup, "SMALL", 4)
    rows = corpus(5, 1, 150, 50, edits)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80, block=16, shingles=1000)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == plain(rows, 2, 80)


def test_pairs_grow_with_the_group_not_with_its_square(spark, monkeypatch):
    """400 near copies of one text have 79,800 pairs; few of them ever become rows."""
    seen = []
    confirmed = near_dedup.confirmed

    def counted(percent, size):
        seen.append(percent)
        return confirmed(percent, size)

    monkeypatch.setattr(near_dedup, "confirmed", counted)
    cut, rows = near_dedup.Scratch.cut, []

    def written(self, df):
        out = cut(self, df)
        if df.columns == ["u", "v"]:
            rows.append(out.count())
        return out

    monkeypatch.setattr(near_dedup.Scratch, "cut", written)
    docs = corpus(9, 1, 400, 120, 6)
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 2, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == plain(docs, 2, 80)
    assert seen and rows and max(rows) <= 10 * len(docs)


def twins():
    """Two words of 1024 bytes whose sums of byte values times powers of any odd number are equal modulo 2**64."""
    odd = [bin(i).count("1") % 2 for i in range(1024)]
    return "".join("ab"[x] for x in odd), "".join("ba"[x] for x in odd)


def test_words_are_told_apart_byte_by_byte(spark):
    a, b = twins()
    rows = [(1, a), (2, b), (3, f"one {a} two"), (4, f"one {b} two"), (5, " ".join([a, b] * 40)), (6, " ".join([b, a] * 40))]
    for size in (1, 2, 5):
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size, 80).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain(rows, size, 80)


def test_hashes_alone_link_nothing(spark, monkeypatch):
    """Even if all words had one hash, the texts decide."""
    monkeypatch.setattr(near_dedup, "values", lambda different: near_dedup.np.full(len(different), 7, near_dedup.np.uint64))
    texts = ["a b c d", "e f g h", "i j k l", "a b c d", "A b C d"]
    batch = near_dedup.pa.record_batch({"u": [0, 0, 0], "v": [1, 3, 4], "text_u": [texts[0]] * 3, "text_v": [texts[1], texts[3], texts[4]]})
    assert [b.column("v").to_pylist() for b in near_dedup.confirmed(80, 2)([batch])] == [[3, 4]]
    assert [len(s) for s in near_dedup.shingle_values(near_dedup.pa.array(["a b c a b d", "a b"]), 2)] == [4, 1]


def test_long_texts_are_taken_in_blocks(monkeypatch):
    from tessella.llm import text_arrays

    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(4000)) for _ in range(3)]
    texts.append(texts[0].replace(" w7 ", " W7  "))
    whole = [near_dedup.shingle_values(near_dedup.pa.array([t]), 3) for t in texts]
    sets = near_dedup.exact_sets(near_dedup.pa.array(texts), 3)
    monkeypatch.setattr(near_dedup, "BLOCK", 500)
    monkeypatch.setattr(near_dedup, "LONG", 500)
    monkeypatch.setattr(near_dedup, "blocks", lambda data, overlap: text_arrays.blocks(data, overlap, 500))
    for t, w in zip(texts, whole, strict=True):
        (got,) = near_dedup.shingle_values(near_dedup.pa.array([t]), 3)
        assert sorted(got) == sorted(w[0])
    long = near_dedup.exact_sets(near_dedup.pa.array(texts), 3)
    assert [len(s) for s in long] == [len(s) for s in sets]
    for percent in (1, 3, 80, 100):
        for i in range(4):
            assert [near_dedup.similar(long[i], x, percent) for x in long] == [near_dedup.similar(sets[i], x, percent) for x in sets]


def test_the_session_keeps_its_settings(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for value in ("10000", "20000"):
        spark.conf.set(name, value)
        near_dedup.near_duplicates(spark.createDataFrame([(1, "a b")], "doc_id long, text string")).collect()
        assert spark.conf.get(name) == value
    spark.conf.unset(name)


def test_odd_rows(odd, none):
    rows = near_dedup.near_duplicates(odd, 2, 80).collect()
    assert len(rows) == 11
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert (by[1].n_shingles, by[2].n_shingles, by[3].n_shingles, by[4].n_shingles) == (0, 0, 0, 1)
    assert by[6].component_id == 5 and not by[6].kept and by[5].kept and by[7].kept and by[1].component_id == 1
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    assert near_dedup.near_duplicates(none).count() == 0


def test_one_id_with_two_texts_joins_both_groups(spark):
    rows = [(1, "a b c d"), (3, "a b c d"), (3, "p q r s"), (9, "p q r s")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    assert {r.component_id for r in got} == {1}


def test_query_on_the_test_table(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op1_minhash_near_dedup(spark, small).collect()}
    assert got == plain(rows, 2, 80)
