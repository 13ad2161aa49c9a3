"""Quality and language: held-out accuracy, odd rows, no peeking at other columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from logquarry.llm import langid, quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_on_held_out_rows(tables):
    docs, labels = tables
    rated = quality.score(docs, quality.train(docs, labels)).join(labels, "doc_id").where(quality.held_out())
    r = rated.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("accuracy"), F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    assert r["n"] > 50 and r["accuracy"] > 0.95 and 0 <= r["low"] <= r["high"] <= 1


def test_column_equals_numpy(tables, spark):
    docs, labels = tables
    model = quality.train(docs, labels)
    assert 0 < len(model.rules) < 200
    rows = quality.statistics(docs).withColumn("score", model.column()).select("statistics.*", "score").toPandas()
    assert np.allclose(model.predict(rows[list(quality.STATISTICS)].to_numpy()), rows["score"], atol=1e-12)


def test_quality_without_labels_and_odd_rows(spark, docs, odd, clash):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    frame = clash(list(odd)).drop("statistics", "score", "predicted")
    out = quality.score(frame, quality.train(frame, none))
    assert out.count() == len(odd) and {r["score"] for r in out.collect()} == {0.5}
    one_class = spark.createDataFrame([(2, 1, 0), (3, 1, 0), (4, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.score(frame, quality.train(frame, one_class)).where("predicted = 1").count() == len(odd)
    assert quality.score(docs([]).drop("x"), quality.train(docs([]), none)).count() == 0


def test_measures():
    m = dict(zip(quality.STATISTICS, quality.measure(b"AB ab ab!\nx"), strict=True))
    assert m["upper"] == 2 / 11 and m["bang"] == 1 / 11 and m["repeats"] == 0 and m["distinct_words"] == 1.0 and m["distinct_lines"] == 1
    assert quality.measure(b"") == (0.0,) * len(quality.STATISTICS)
    assert dict(zip(quality.STATISTICS, quality.measure(b"a a a b"), strict=True))["repeats"] == 0.5


def test_language_on_held_out_rows(tables):
    docs, _ = tables
    net = langid.train(docs)
    rated = langid.identify(docs, net).where(langid.held_out())
    r = rated.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")).alias("accuracy"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    assert r["accuracy"] > 0.97 and 0 <= r["low"] and r["high"] <= 1
    again = langid.train(docs)
    assert all(np.array_equal(a, b) for a, b in zip(net.filters, again.filters, strict=True))


def test_table_look_ups_equal_the_network():
    rng = np.random.default_rng(0)
    net = langid.Net(("a", "b"), rng.normal(size=(256, langid.EMBED)).astype(np.float32), tuple(rng.normal(size=(w, langid.EMBED, langid.FILTERS)).astype(np.float32) for w in langid.WIDTHS), rng.normal(size=24).astype(np.float32), rng.normal(size=(24, 2)).astype(np.float32), np.zeros(2, np.float32))
    texts = [bytes(rng.integers(1, 256, n).astype(np.uint8)) for n in (0, 1, 5, 253, 254, 1000)]
    got = langid.Predictor(net).probabilities(texts)
    for t, p in zip(texts, got, strict=True):
        n = langid.windows_of(len(t))
        raw = np.frombuffer(t.ljust(n * langid.STEP, b"\0") + bytes(3), np.uint8)
        probs = []
        for k in range(n):
            x = net.embed[raw[k * langid.STEP : k * langid.STEP + langid.WINDOW]]
            conv = np.concatenate([sum(x[j : j + langid.STEP] @ f[j] for j in range(len(f))) for f in net.filters], axis=1)
            z = np.maximum(conv.max(axis=0) + net.bias, 0) @ net.out
            probs.append(np.exp(z - z.max()) / np.exp(z - z.max()).sum())
        weight = [langid.STEP] * (n - 1) + [max(len(t) - (n - 1) * langid.STEP, 1e-3)]
        assert np.allclose(p, np.average(probs, axis=0, weights=weight), atol=1e-5)


def test_language_odd_rows(spark, docs, odd, clash):
    frame = clash(list(odd)).drop("score")
    assert {r["lang_pred"] for r in langid.identify(frame, None).collect()} == {"und"}
    train = docs([(i, t) for i, t in enumerate(["hello there world " * 20] * 30)])
    out = {(r["doc_id"], r["text"] is None): (r["lang_pred"], r["score"]) for r in langid.identify(frame, langid.train(train)).collect()}
    assert out[1, True] == ("und", 0.0) and out[2, False] == ("und", 0.0) and out[3, False] == ("und", 0.0)
    assert out[7, False][0] == "en" and out[5, False][0] == "en"
    assert langid.train(docs([])) is None
    assert langid.identify(docs([]), None).count() == 0


def test_language_sample_with_null_and_repeated_ids(docs):
    """Ids that are null or repeated neither empty the sample nor fill it."""
    texts = {"en": "hello there world ", "de": "guten tag welt "}
    pairs = [(None, f"{texts['en']}{i} " * 5) for i in range(300)] + [(7, f"{texts['de']}{i} " * 5) for i in range(300)] + [(9, texts["en"] * 9)] * 300
    frame = docs(pairs).withColumn("lang", F.when(F.col("doc_id") == 7, "de").otherwise("en"))
    net = langid.train(frame, 100)
    assert net.langs == ("de", "en")
    out = {r["text"][:5]: r["lang_pred"] for r in langid.identify(frame.dropDuplicates(["doc_id"]), net).collect()}
    assert out == {"hello": "en", "guten": "de"}


def test_every_language_is_learned(docs, spark):
    rng = np.random.default_rng(2)
    rows = [(100 * g + i, "".join(chr(0x4E00 + 4 * g + int(x)) for x in rng.integers(0, 4, 60)), f"l{g:03}") for g in range(230) for i in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.train(frame, 500)
    assert net.langs == tuple(sorted({r[2] for r in rows if not _held(r[0])}))
    assert len(net.langs) > 200


def _held(doc_id):
    import zlib

    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_quality_sample_with_repeated_ids(spark, docs):
    """A label's id that very many rows repeat is one row of the sample."""
    from unittest import mock

    frame = docs([(8, f"text {i}") for i in range(200)] + [(i, "other words here") for i in range(20, 60)])
    labels = spark.createDataFrame([(8, 1, 0)] + [(i, 0, 0) for i in range(20, 60)], "doc_id long, quality int, toxic int")
    with mock.patch.object(quality, "fit", wraps=quality.fit) as fit:
        quality.train(frame, labels)
    x, y = fit.call_args.args[:2]
    assert len(x) == len(y) <= 41 and y.sum() <= 1
