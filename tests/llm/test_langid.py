import numpy as np
import pytest

from tesserae.llm import langid


def test_held_out_accuracy(small):
    got = langid.op10(small).join(small.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_edges(edge, empty):
    got = langid.op10(edge).collect()
    assert len(got) == edge.count() and langid.op10(empty).count() == 0
    model = langid.fit_chain_model(["the house of the old man"] * 8, ["en"] * 8)
    rows = langid.identify(edge, model, names=("p", "s")).collect()
    for r in rows:
        assert (r["p"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) and 0 <= r["s"] <= 1


def test_no_labels_gives_und(small):
    from pyspark.sql import functions as F

    rows = langid.op10(small.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in rows} == {"und"} and {r["score"] for r in rows} == {0.0}


def test_code_switched_words():
    en, de = "the house and the garden with many old trees of that town", "das haus und der garten mit vielen alten bäumen dieser stadt"
    model = langid.fit_chain_model([en] * 30 + [de] * 30, ["en"] * 30 + ["de"] * 30)
    total, size = langid.Tagger(model).totals([f"{en} {de}", None, "123"])
    share = total[0] / size[0]
    assert model.labels == ["de", "en"] and abs(share[0] - 0.5) < 0.15
    assert size.tolist()[1:] == [0, 0]


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    emit, trans, start = rng.random((4, 1, 3)), rng.random((3, 3)), rng.random(3)
    got = langid._marginals(emit, np.ones((4, 1), dtype=bool), trans, start)[:, 0]
    want = np.zeros((4, 3))
    for path in np.ndindex(3, 3, 3, 3):
        p = start[path[0]] * emit[0, 0, path[0]]
        for t in range(1, 4):
            p *= trans[path[t - 1], path[t]] * emit[t, 0, path[t]]
        for t in range(4):
            want[t, path[t]] += p
    assert np.allclose(got, want / want.sum(1, keepdims=True))


def test_long_runs_are_read_whole():
    en, de = "the house and the garden with many old trees of that town", "das haus und der garten mit vielen alten bäumen dieser stadt"
    model = langid.fit_chain_model([en, en.replace(" ", "-")] * 30 + [de, de.replace(" ", "-")] * 30, ["en"] * 60 + ["de"] * 60)
    long = "-".join([en] * 40).replace(" ", "-")
    parts = langid.pieces(f"«{long}» ok")
    assert "".join(parts[:-1]) == long and max(map(len, parts)) <= langid.LONGEST and parts[-1] == "ok"
    total, size = langid.Tagger(model).totals([f"und der {long} das haus", f"das-haus-und-{long}-bäumen-dieser-stadt"])
    assert size[0] >= len(long) / langid.LONGEST and (total[:, model.labels.index("en")] / size > 0.8).all()
    assert langid.pieces("x" * 24) == ["x" * 24] and langid.pieces(None) == []


def test_no_label_is_lost(spark):
    docs = spark.createDataFrame([(i, f"text {i}", f"l{i % 5}") for i in range(20)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="over 4 labels"):
        langid.training_sample(docs, most_labels=4)
    assert {r["lang"] for r in langid.training_sample(docs, most_labels=5).collect()} == {f"l{i}" for i in range(5)}
