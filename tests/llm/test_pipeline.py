import corpus_pipeline
from tessella.llm.scratch import Scratch
from tests.llm.test_near_dedup import plain as components
from tests.llm.test_passages import plain as windows


def test_stages_take_effect(spark, small):
    scratch = Scratch(spark, "test")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(scratch.cut(stage(spark, seen[-1], small)))
    raw, good, unique, trimmed, clean, packed = ({r.doc_id: r for r in f.collect()} if "text" in f.columns else f.collect() for f in seen)
    assert all(f.columns == docs.columns for f in seen[1:-1])
    assert 0.7 * len(raw) < len(good) < len(raw)
    assert set(unique) == {i for i, (_, c) in components([(i, r.text) for i, r in good.items()], 5, 80).items() if i == c}
    assert set(trimmed) == set(unique)
    for i, n, removed, _ in windows([(i, r.text) for i, r in unique.items()], 50):
        assert len(trimmed[i].text.split()) == n - removed and (removed or trimmed[i].text == unique[i].text)
        assert trimmed[i].n_chars == (len(trimmed[i].text) if removed else unique[i].n_chars)
    items = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert not any(t in r.text for t in items for r in clean.values()) and len(clean) > 0.9 * len(trimmed)
    assert {r.doc_id for r in packed} == set(clean)


def test_run_gives_the_last_stage(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0


def test_odd_documents_pass_through(spark, odd, small):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    scratch = Scratch(spark, "test")
    for _, stage in corpus_pipeline.STAGES:
        docs = scratch.cut(stage(spark, docs, small))
    assert docs.count() > 0


def test_rows_of_null_and_repeated_doc_ids_are_decided_one_by_one(spark, small):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    prose = " ".join(f"w{i}" for i in range(80))
    item = spark.read.parquet(f"{small}/benchmark.parquet").first().text
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in [(None, prose), (None, prose), (7, prose), (7, prose), (8, item), (8, "clean words"), (None, item), (9, "")]], schema)
    unique = corpus_pipeline.near_dedup(spark, docs, small).collect()
    assert sum(r.text == prose for r in unique) == 1 and sum(r.text == item for r in unique) == 1
    clean = corpus_pipeline.decontaminate(spark, docs, small).collect()
    assert sorted((str(r.doc_id), r.text) for r in clean) == sorted([("None", prose)] * 2 + [("7", prose)] * 2 + [("8", "clean words"), ("9", "")])
