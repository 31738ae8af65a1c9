from pyspark.sql import functions as F

from tessella.llm import language, quality, queries
from tessella.llm.sampling import one_of_each

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "n_chars")
    rows = queries.op2_byte_cnn_language(spark, SF).join(truth, "doc_id").where("n_chars > 40").toPandas()
    held = rows[rows.held_out]
    assert len(held) > 100 and (held.lang_pred == held.lang).mean() > 0.97
    assert rows.score.between(0, 1).all() and (rows.held_out == rows.doc_id.map(lambda i: __import__("zlib").crc32(str(i).encode()) % 4 == 2)).all()


def test_language_of_odd_rows(odd, none):
    rows = language.identify_language(odd).collect()
    assert len(rows) == 11
    by = {r.doc_id: r.lang_pred for r in rows if r.doc_id is not None}
    assert {by[i] for i in (1, 2, 3, 8)} == {"und"} and {by[5], by[7]} <= {"en", "de"}
    assert language.identify_language(none).count() == 0
    untaught = language.identify_language(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in untaught} == {("und", 0.0)}


def test_short_texts_are_learned(spark):
    """All rows of one language are shorter than a window and a quarter of one."""
    rows = [(i, f"the cat and dog {i % 10}!", "en") for i in range(40)]
    rows += [(100 + i, " ".join(["der Hund und die Katze", str(i), "schlafen nicht immer über dem Haus"] * 6), "de") for i in range(40)]
    got = language.identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r.lang_pred for r in got if r.doc_id < 100} == {"en"} and {r.lang_pred for r in got if r.doc_id >= 100} == {"de"}


def test_responses_equal_a_plain_convolution():
    network = language.ByteNetwork(["a", "b"], seed=3)
    rng = language.np.random.default_rng(1)
    x = rng.integers(0, 256, (5, language.WINDOW)).astype(language.np.uint8)
    parts = []
    for w in language.WIDTHS:
        e = network.p["e"][x]  # window, place, embedding
        places = [sum(e[:, i + k] @ network.p[f"w{w}"][k] for k in range(w)) + network.p[f"b{w}"] for i in range(language.WINDOW - w + 1)]
        parts.append(language.np.max(places, axis=0))
    z = language.np.maximum(language.np.concatenate(parts, 1), 0) @ network.p["o"] + network.p["c"]
    z = language.np.exp(z - z.max(axis=1, keepdims=True))
    assert abs(network.probabilities(x) - z / z.sum(axis=1, keepdims=True)).max() < 1e-5


def test_many_languages_share_the_sample(spark):
    rows = [(i, f"text {i} of language {i % 30}", f"l{i % 30}") for i in range(300)]
    network = language.fit_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=8 * 30)
    assert len(network.languages) == 30


def test_quality_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = queries.op10_random_indexing_quality(spark, SF).join(labels, "doc_id").toPandas()
    held = rows[rows.held_out]
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.93
    assert (held[held.quality == 1].predicted == 1).mean() > 0.95
    assert (rows.predicted == (rows.score >= 0.3)).all()


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 0), (7, 0, 0), (4, 0, 1), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    rows = quality.score_quality(odd, labels).collect()
    assert len(rows) == 11 and all(0 <= r.score <= 1 for r in rows)
    assert quality.score_quality(none, labels).count() == 0
    assert {r.score for r in quality.score_quality(odd, labels.limit(0)).collect()} == {0.5}
    kept = quality.accept_quality(odd, labels)
    assert kept.columns == odd.columns and kept.count() == sum(r.predicted for r in rows)
    assert quality.accept_quality(odd, labels.limit(0)).count() == 11


def test_samples_are_bounded_and_whole_where_small(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 4990, "a").otherwise("b").alias("k"))
    counts = {r.k: r["count"] for r in one_of_each(rows, "k", "doc_id", 64).groupBy("k").count().collect()}
    assert counts["a"] == 64 and 5 <= counts["b"] <= 10
