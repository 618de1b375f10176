"""Language, quality and toxicity on small invented corpora: held-out accuracy and edge cases."""

import math
import pickle
import random
import re
import zlib

import numpy as np
import pytest

from postmill.llm import language, quality, toxicity

SYLLABLES = {"aa": ["tha", "ing", "er", "wh", "ou", "st"], "bb": ["sch", "ung", "ei", "pf", "ä", "ich"], "cc": ["ción", "ll", "ado", "ñ", "os", "que"]}


def words(rng, lang, n):
    return ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n)]


def corpus(n, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(words(rng, lang, rng.randrange(5, 120))), lang) for i, lang in enumerate(rng.choices(list(SYLLABLES), k=n))]


def test_language(spark):
    train = spark.createDataFrame([*corpus(300), (None, "x", "aa"), (5, None, "aa"), (6, "x", None)], "doc_id long, text string, lang string")
    model = language.fit_dictionaries(train)
    assert set(model) == set(SYLLABLES) and all(len(v) > 1000 for v in model.values())
    rows = [*corpus(200, 2), (900, None, "aa"), (901, "12 34 !!", "aa"), (902, "", "aa"), (None, "thaing ouwh", "aa"), (903, "thaing ouwh " * 20_000, "aa")]
    test = spark.createDataFrame([(i, t, lang, 7.0) for i, t, lang in rows], "doc_id long, text string, lang string, score double")
    got = language.identify(test, model, keep=["doc_id", "lang"]).collect()
    assert len(got) == len(rows)
    assert sum(r.lang == r.lang_pred for r in got[:200]) >= 196
    assert [(r.lang_pred, r.score, r.rejected) for r in got[200:203]] == [("und", 0.0, True)] * 3
    assert got[204].lang_pred == "aa" and all(0 <= r.score <= 1 for r in got)
    assert language.identify(test.limit(0), model).collect() == []
    assert {r.lang_pred for r in language.identify(test, language.fit_dictionaries(train.limit(0))).collect()} == {"und"}


@pytest.mark.parametrize("text,letter", [("½ ²³ Ⅷ 12", False), ("_-%", False), ("٣ ⑦", False), ("7 ª", True), ("中", True), ("1 é", True), ("", False)])
def test_letters(spark, text, letter):
    assert language.has_letter(text) == letter
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = language.identify(frame, {"aa": b"tha ing er", "bb": b"sch ung ei"}).first()
    assert (row.lang_pred != "und") == letter and (letter or (row.rejected and row.score == 0.0))


def test_language_dictionaries_hold_whole_rows(spark):
    """Rows are chosen by hash, whole, until the dictionary is full; longer rows are no part of it."""
    rows = [(i, f"Row{i} " + "x" * (i % 50), "aa") for i in range(400)] + [(900, "long " * 100, "aa"), (1, "only", "bb")]
    rows += rows[:100]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language.fit_dictionaries(train, dict_bytes=2000, row_bytes=100)
    own = {t.lower() for _, t, lang in rows if lang == "aa" and len(t) <= 100}
    held = model["aa"].decode().split("\n")
    assert list(model) == ["aa", "bb"] and model["bb"] == b"only"
    assert len(held) == len(set(held)) and set(held) <= own and 1850 < len(model["aa"]) <= 2000
    assert language.fit_dictionaries(train.repartition(5), dict_bytes=2000, row_bytes=100) == model


def test_language_against_plain_compression(spark):
    """Scores recomputed with one-shot compressors of the library, block after block."""
    import zstandard

    model = language.fit_dictionaries(spark.createDataFrame(corpus(200), "doc_id long, text string, lang string"))
    rows = [*corpus(60, 7), (900, "Tha ", "aa"), (901, "mixed " + "schung ei pf " * 9 + "thaing er ou st " * 9, "bb"), (902, "x" * 9000, "aa")]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()
    for (i, text, _), r in zip(rows, got, strict=True):
        data, sizes = text.lower().encode(), {}
        for name, words in model.items():
            own = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            packer = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=own, write_content_size=False)
            sizes[name] = sum(len(packer.compress(data[k:k + language.BLOCK])) for k in range(0, len(data), language.BLOCK))
        order = sorted(sizes, key=lambda k: (sizes[k], list(model).index(k)))
        best, second = sizes[order[0]], sizes[order[1]]
        assert (r.doc_id, r.lang_pred) == (i, order[0])
        assert abs(r.score - (second - best) / second) < 0.03 and 0 <= r.score <= 1
        assert r.rejected == (r.score < language.MIN_MARGIN)


def test_language_rejects_narrow_margins(spark):
    rng = random.Random(5)
    model = language.Identifier(language.fit_dictionaries(spark.createDataFrame(corpus(300), "doc_id long, text string, lang string")))
    noise = [model.predict("".join(rng.choice("bcdfgjkmqvxyz ") for _ in range(400)))[1] < language.MIN_MARGIN for _ in range(50)]
    clean = [model.predict(t)[1] < language.MIN_MARGIN for _, t, _ in corpus(200, 9) if len(t) > 60]
    assert sum(noise) > 25 and sum(clean) <= 1


def quality_corpus(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w, good = words(rng, rng.choice(["aa", "bb"]), rng.randrange(30, 200)), rng.random() < 0.7
        if not good:
            mark = rng.choice(["!!", "%%%", " |", "$$$"])
            w[len(w) // 2:] = [x + mark for x in w[len(w) // 2:]]
        out.append((i, " ".join(w), int(good)))
    return out


def test_quality(spark):
    rows = quality_corpus(300, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, quality int")
    net = quality.fit_quality(docs, labels)
    test = [*quality_corpus(120, 2), (900, None, 1), (901, "", 1), (902, "a", 1), (None, "thaing " * 30_000 + "!!%% " * 30, 0)]
    frame = spark.createDataFrame([(i, t, "x") for i, t, _ in test], "doc_id long, text string, score string")
    got = quality.score_quality(frame, net).collect()
    right = [r.predicted == y for r, (_, _, y) in zip(got[:120], test, strict=False)]
    assert sum(right) >= 114 and all(0 <= r.score <= 1 for r in got)
    assert got[120].score == got[121].score and got[-1].score < 0.3  # null as empty; junk at the end of a long text counts
    assert quality.score_quality(frame.limit(0), net).count() == 0
    assert quality.train([]).score("x") == 0.5 and quality.train([("x", 1)]).score("y") > 0.9


def test_quality_chunks_equal_one_piece():
    rng = np.random.default_rng(3)
    net = quality.train([("abcdefgh", 1), ("!!!!!!!!", 0)])
    x = rng.integers(32, 127, 3 * quality.CHUNK + 17).astype(np.uint8)
    assert np.allclose(net.pooled(x)[0], np.maximum(net._responses(x).max(axis=0) + net.bias, 0))


def test_quality_against_plain_convolution(spark):
    """Scores recomputed weight by weight, place by place."""
    net = quality.train([(t, y) for _, t, y in quality_corpus(40, 4)])
    texts = ["", None, "a", "abcde", "Ünï !!", "thaing er " * 30 + "%%% $$$", "x" * 50]

    def plain(text):
        data = (text or "").encode()
        data += b"\0" * (quality.WIDTH - len(data))
        top = [max(sum(float(net.tables[k][data[i + k]][f]) for k in range(quality.WIDTH))
                   for i in range(len(data) - quality.WIDTH + 1)) for f in range(quality.FILTERS)]
        total = sum(max(0.0, t + float(b)) * float(w) for t, b, w in zip(top, net.bias, net.out, strict=True)) + net.out_bias
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))

    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for t, r in zip(texts, quality.score_quality(frame, net).collect(), strict=True):
        assert r.score == pytest.approx(plain(t), abs=1e-4) and r.predicted == int(r.score >= 0.3)


def test_sample_is_bounded_whole_and_repeatable(spark):
    from postmill.llm.common import labelled_sample

    rows = [(i, f"text {i} " * (1 + i % 40)) for i in range(300)] * 2 + [(7, "another text of seven"), (301, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(300)] + [(301, 0), (None, 1), (4, None), (5, 7)], "doc_id long, y int")
    found = labelled_sample(docs.repartition(5), labels.repartition(3), "y", 25)
    assert found == labelled_sample(docs, labels, "y", 25)
    assert sum(y for _, y in found) == 25 and len(found) in (49, 50)
    whole = {t: i for i, t in rows if t}
    assert all(t in whole and y == int(whole[t] % 10 == 0) for t, y in found) and len({t for t, _ in found}) == len(found)
    assert labelled_sample(docs, labels.limit(0), "y", 25) == [] == labelled_sample(docs.limit(0), labels, "y", 25)


def toxic_corpus(n, seed):
    rng = random.Random(seed)
    bad = ["idiot", "moron", "qulaxa", "qulabo", "qulacc"]
    out = []
    for i in range(n):
        w, toxic = words(rng, rng.choice(list(SYLLABLES)), rng.randrange(20, 300)), rng.random() < 0.4
        for _ in range(rng.randrange(1, 6) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        out.append((i, " ".join(w), int(toxic)))
    return out


def test_toxicity(spark):
    rows = toxic_corpus(400, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = pickle.loads(pickle.dumps(toxicity.fit_toxicity(docs, labels)))
    test = [*toxic_corpus(150, 2), (900, None, 0), (901, "", 0), (None, "IDIOT moron qulaxa idiot", 1), (902, "thaing " * 50_000 + "moron idiot", 1)]
    got = toxicity.score_toxicity(spark.createDataFrame([(i, t, 5) for i, t, _ in test], "doc_id long, text string, grade int"), model).collect()
    assert sum(r.toxic == bool(y) for r, (_, _, y) in zip(got, test, strict=True)) >= 148
    mild, severe = model.grades("thaing idiot ouwh"), model.grades("idiot moron qulaxa qulabo")
    assert severe @ np.arange(3) > mild @ np.arange(3) > model.grades("thaing ouwh") @ np.arange(3)
    assert all(0 <= r.severity <= 2 and 0 <= r.score <= 1 for r in got) and abs(mild.sum() - 1) < 1e-12
    assert model.thresholds[0] < model.thresholds[1]
    assert not any(toxicity.train([(t, 0) for t in ("a", "b")]).grades("a")[1:] > 0.1)


@pytest.mark.parametrize("make", [lambda d: language.identify(d, {}), lambda d: quality.score_quality(d, quality.train([])),
                                  lambda d: toxicity.score_toxicity(d, toxicity.train([]))])
def test_repeated_rows(spark, make):
    docs = spark.createDataFrame([(1, "same", "x"), (1, "same", "x"), (None, None, None)], "doc_id long, text string, lang_pred string")
    rows = make(docs).collect()
    assert len(rows) == 3 and rows[0] == rows[1]


def test_toxicity_against_plain_regression(spark):
    """Probabilities recomputed from the weights of the features of each text."""
    model = toxicity.train([(t, y) for _, t, y in toxic_corpus(200, 3)])
    texts = ["", None, "Idiot MORON", "thaing ouwh", "qulaxa " * 30, "idiot-moron idiots", "ä1b2 idiotic"]

    def plain(text):
        words = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
        names = {w for w in words} | {"^" + w[:n] for w in words for n in toxicity.BEGINNINGS if len(w) >= n}
        hit = {zlib.crc32(x.encode()) & (toxicity.BUCKETS - 1) for x in names}
        z = sum(model.weights.get(b, 0.0) for b in hit)
        up = [1 / (1 + math.exp(-(t - z))) for t in model.thresholds]
        return [up[0], up[1] - up[0], 1 - up[1]]

    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for t, r in zip(texts, toxicity.score_toxicity(frame, model).collect(), strict=True):
        p = plain(t)
        assert r.score == pytest.approx(p[1] + p[2], abs=1e-9) and r.severity == pytest.approx(p[1] + 2 * p[2], abs=1e-9)
        assert r.grade == p.index(max(p)) and r.toxic == (r.score >= 0.5)


def test_severity_ranks_toxic_texts(spark):
    """Held-out toxic texts: the more different bad words one has, the higher its severity."""
    model = toxicity.train([(t, y) for _, t, y in toxic_corpus(400, 1)])
    bad = ["idiot", "moron", "qulaxa", "qulabo", "qulacc"]
    rng = random.Random(8)
    mean = []
    for k in range(6):
        found = []
        for _ in range(40):
            w = words(rng, rng.choice(list(SYLLABLES)), 80)
            for x in rng.sample(bad, min(k, 5)):
                w.insert(rng.randrange(len(w)), x)
            found.append(float(model.grades(" ".join(w)) @ np.arange(3)))
        mean.append(np.mean(found))
    assert mean == sorted(mean) and mean[3] > mean[1] + 0.2 > mean[0] + 0.4
