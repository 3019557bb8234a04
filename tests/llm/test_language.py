import numpy as np

from cairnframe.llm import language
from tests.llm.helpers import clashing, documents, saved


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = language.op3_language(spark, sf).collect()
    import zlib

    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_codewords_are_far_apart():
    for n in (2, 3, 4, 5, 6, 9, 20):
        code = language.codewords(n)
        least = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        assert least >= (1 if n == 2 else 2)
        assert not (np.abs(code.sum(axis=0)) == n).any()


def test_a_wrong_bit_is_corrected():
    model = language.Model(["a", "b", "c", "d"], language.codewords(4), np.zeros((1, 7)), np.zeros(7), np.full((4, 7), 1 / 7))
    margins = language.codewords(4) * 3
    margins[:, 2] *= -1
    best, score, close = model.decode(margins)
    assert best.tolist() == [0, 1, 2, 3] and not close.any() and (score > 0.5).all()
    assert model.decode(np.zeros((1, 7)))[2].all()


def test_odd_rows(spark, tmp_path):
    rows = language.op3_language(spark, saved(clashing(documents(spark)), tmp_path)).collect()
    assert len(rows) == 9
    by = {r.doc_id: r for r in rows}
    assert [by[k].lang_pred for k in (0, 1, 7)] == ["und"] * 3
    assert by[2].lang_pred in ("en", "fr", "und") and by[None].held_out is False


def test_nothing_to_learn_and_one_language(spark, tmp_path):
    empty = language.train(documents(spark, []))
    assert empty.languages == [] and empty.predict(["some words"])[0][0] == "und"
    one = language.train(documents(spark, [(i, "only one language here", "en", "s", 1) for i in range(9)]))
    assert one.predict(["whatever", "123"]) == [("en", 1.0, False), ("und", 0.0, True)]
    assert language.predict(documents(spark, []), one).collect() == []


def grams_of(text):
    """Hashed n-grams of a text, one after the other, in a plain dictionary."""
    m32 = 0xFFFFFFFF
    x = [c if c.isalpha() else " " for c in text.lower()]
    found = {}
    for i in range(len(x) - 1):
        a, b = ord(x[i]), ord(x[i + 1])
        h2 = (a * 0x9E3779B1 & m32) ^ (b * 0x85EBCA77 & m32)
        if x[i] != " " or x[i + 1] != " ":
            k = ((h2 ^ h2 >> 15) * 0x2C1B3C6D & m32) >> 20
            found[k] = found.get(k, 0) + 1
        if i + 2 < len(x) and x[i + 1] != " ":
            h3 = ((h2 * 0xC2B2AE3D & m32) + (ord(x[i + 2]) * 0x27D4EB2F & m32)) & m32
            k = (((h3 ^ h3 >> 15) * 0x2C1B3C6D & m32) >> 20) + language.BUCKETS
            found[k] = found.get(k, 0) + 1
    return found


def slow_decode(model, text):
    import math

    if not any(c.isalpha() for c in text):
        return "und", 0.0, None
    grams = grams_of(text)
    n = max(1, sum(grams.values()))
    margins = [sum(k * float(model.weights[g, b]) for g, k in grams.items()) / n + float(model.bias[b]) for b in range(model.code.shape[1])]
    loss = {}
    for row, lang in enumerate(model.languages):
        loss[lang] = sum(float(model.trust[row, b]) * math.log1p(math.exp(-m * float(model.code[row, b]))) for b, m in enumerate(margins))
    best = min(loss, key=loss.get)
    return best, 1 / sum(math.exp(-4 * (x - loss[best])) for x in loss.values()), margins


def test_predictions_against_a_slow_decoder(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = language.train(docs)
    texts = [r.text for r in docs.select("text").limit(60).collect() if len(r.text) < 4000] + ["Übergröße ist ΑΣ, straße!", "a", "é", "x1y2z3", "\x00\x00 word", "İstanbul ΣΑΣ", "漢字 かな", "1 2 3", ""]
    want = [slow_decode(model, t) for t in texts]
    for got in (model.predict(texts), [model.predict_one(t) for t in texts]):
        for (lang, score, _), (best, p, _), t in zip(got, want, texts, strict=True):
            assert lang == best and abs(score - p) < 1e-6, t
    monkeypatch.setattr(language, "_SLICE", 7)  # every text is cut into many slices
    assert [(lang, round(s, 6)) for lang, s, _ in (model.predict_one(t) for t in texts)] == [(lang, round(s, 6)) for lang, s, _ in want]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in language.predict(table, model).collect()}
    assert all(rows[i].lang_pred == w[0] and abs(rows[i].score - w[1]) < 1e-6 for i, w in enumerate(want))


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_ROWS", 40)
    seen = []
    monkeypatch.setattr(language, "fit", lambda x, y, **k: seen.append(list(y)))
    rows = [(i, f"text number {i} in a language", f"l{i % 4}", "s", 1) for i in range(400)] + [(3, f"row {i} of one id", "l3", "s", 1) for i in range(90)]
    language.train(documents(spark, rows))
    assert {lang: seen[0].count(lang) for lang in set(seen[0])} == {f"l{k}": 10 for k in range(4)}
