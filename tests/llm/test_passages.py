import hashlib
import random

import pytest

from tessella.llm import passages, queries


def plain(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for j in range(len(w) - window + 1):
            key = tuple(w[j : j + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone.update(range(j, j + window))
        left = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(left).hexdigest()))
    return sorted(out)


def corpus(seed, docs, vocabulary):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    shared = [[word() for _ in range(rng.randrange(20, 140))] for _ in range(6)]
    rows = []
    for i in range(docs):
        text = [word() for _ in range(rng.randrange(120))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(shared)
            a = rng.randrange(len(p))
            text += p[a : a + rng.randrange(len(p))] + [word() for _ in range(rng.randrange(30))]
        rows.append((i, " ".join(text)))
    rows += [(docs + i, t) for i, (_, t) in enumerate(rows[:5])]
    rows.append((docs + 9, " ".join(["same"] * 130)))
    rows.append((docs + 10, " ".join(["same"] * 70 + ["other"] * 70)))
    return rows


@pytest.mark.parametrize("seed, vocabulary, window", [(1, 3000, 50), (2, 3, 50), (3, 50, 12)])
def test_equals_plain_windows(spark, seed, vocabulary, window):
    rows = corpus(seed, 60, vocabulary)
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), window)
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == plain(rows, window)


def test_an_empty_automaton_removes_nothing(spark, monkeypatch):
    """Words go only where the automaton has located a phrase."""
    rows = corpus(1, 60, 3000)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sum(r.n_removed for r in passages.repeated_passages(docs).collect()) > 0
    batches = [passages.pa.record_batch({"doc_id": [1], "text": [rows[0][1]], "confirmed": [[]]})]
    words = passages.Words(passages.pa.array([rows[0][1]]))
    _, first, end, phrase = (x.tolist() for x in passages.passages(words, 12))
    one = {"phrase": bytes(words.run(phrase[0], phrase[0] + 8)), "at": phrase[0] - first[0], "n": end[0] - first[0], "passage": passages.digest(words.run(first[0], end[0])), "removed": True}
    batches = [passages.pa.record_batch({"doc_id": [1], "text": [rows[0][1]], "confirmed": [[one]]})]
    (got,) = passages.located(12)(batches)
    assert len(got.column("gone")[0].as_py()) == 16 and got.column("text")[0].as_py() == rows[0][1]
    monkeypatch.setattr(passages, "compiled", lambda phrases: passages.ahocorasick.Automaton())
    (got,) = passages.located(12)(batches)
    assert got.column("gone")[0].as_py() == b"" and got.column("text")[0].as_py() is None


def test_a_passage_is_removed_only_if_its_bytes_are_confirmed(spark):
    odd = [bin(i).count("1") % 2 for i in range(1024)]  # words that agree in sums over powers modulo 2**64
    a, b = "".join("ab"[x] for x in odd), "".join("ba"[x] for x in odd)
    frame = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"{frame} {a}"), (2, f"{frame} {b}"), (3, " ".join([a] * 61)), (4, " ".join([b] * 61)), (5, f"{a} {frame[3:]}"), (6, f"{b} {frame[3:]}")]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), 50)
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == plain(rows, 50)


def test_long_texts_are_surveyed_in_blocks(monkeypatch):
    rows = corpus(7, 40, 40)
    text = " ".join(t for _, t in rows)
    batch = [passages.pa.record_batch({"doc_id": [1], "text": [text]})]

    def covered(batches):
        out = set()
        for b in batches:
            for at in zip(*(b.column(c).to_pylist() for c in ("phrase", "passage", "n")), strict=True):
                out.add(at[0])
        return out

    whole = covered(passages.surveyed(12)(batch))
    monkeypatch.setattr(passages, "BLOCK", 300)
    monkeypatch.setattr(passages, "blocks", lambda data, overlap: __import__("tessella.llm.text_arrays", fromlist=["blocks"]).blocks(data, overlap, 700))
    assert covered(passages.surveyed(12)(batch)) == whole
    monkeypatch.setattr(passages, "STREAM", 10)
    words = passages.Words(passages.pa.array([text]))
    own = text.split()
    phrases = {" ".join(own[i : i + 8]).encode() for i in range(0, len(own) - 8, 5)}
    assert sorted(passages.hits(passages.compiled(phrases), words)) == sorted((i, p) for i in range(len(own) - 7) if (p := " ".join(own[i : i + 8]).encode()) in phrases)


def test_odd_rows(odd, none):
    rows = passages.repeated_passages(odd).collect()
    assert len(rows) == 11
    by = {r.doc_id: (r.n_words, r.n_removed) for r in rows if r.doc_id is not None}
    assert by == {1: (0, 0), 2: (0, 0), 3: (0, 0), 4: (1, 0), 5: (12000, 0), 6: (12000, 12000), 7: (6, 0), 8: (3, 0)}
    assert all(r.n_removed == 0 for r in rows if r.doc_id is None)
    assert passages.repeated_passages(none).count() == 0 and passages.without_repeats(none).count() == 0
    kept = passages.without_repeats(odd)
    assert kept.columns == odd.columns and kept.count() == 11 and kept.where("doc_id = 6").first().text == ""


def test_query_on_the_test_table(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in queries.op3_repeated_phrase_dedup(spark, small).collect()) == plain(rows, 50)
