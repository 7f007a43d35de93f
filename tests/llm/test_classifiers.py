import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docloom.llm import language, quality

from .helpers import GERMAN, ODD, PROSE, docs


def test_language_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = language.op10_language_id(spark, sf)
    both = got.join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(both) > 200
    assert (both.lang == both.lang_pred).mean() > 0.97
    assert both.score.between(0, 1).all()


def test_language_bears_odd_rows(spark):
    rows = docs(spark)
    model = language.fit(rows)
    assert model.languages == ["de", "en"]
    out = language.identify(rows, model).collect()
    by_id = {r.doc_id: r for r in out}
    assert len(out) == len(ODD)
    assert by_id[10].language == "de" and by_id[6].language == "en"
    for k in (3, 4, 5, 12, 14):
        assert (by_id[k].language, by_id[k].language_score, by_id[k].language_rejected) == ("und", 0.0, True)
    assert by_id[11].language in model.languages
    assert language.identify(docs(spark, []), model).count() == 0
    nothing = language.fit(docs(spark, []))
    assert {r.language for r in language.identify(rows, nothing).collect()} == {"und"}


def test_language_counts_equal_brute_force():
    texts = [PROSE, "", GERMAN, "ÀÉ àé", "a"]
    data, off = language.tx.buffers(pa.array(texts))
    got = language.gram_counts(data, off) ** 2
    assert np.allclose(got.sum(axis=1), [max(0, n) + max(0, n - 1) + max(0, n - 2) for n in (len(t.encode()) for t in texts)])
    alone = [language.gram_counts(*language.tx.buffers(pa.array([t]))) for t in texts]
    assert np.array_equal(np.concatenate(alone) ** 2, got)


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = quality.op2_quality(spark, sf)
    both = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert ((both.predicted == both.quality).mean()) > 0.98
    assert both.score.between(0, 1).all()


def test_quality_bears_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1), (9, 0), (10, None), (77, 1)], "doc_id long, quality int")
    forest = quality.fit(docs(spark), labels)
    out = quality.classify(docs(spark), forest)
    rows = out.collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert quality.classify(docs(spark, []), forest).count() == 0
    empty = quality.fit(docs(spark, []), labels)
    assert quality.classify(docs(spark), empty).select(F.countDistinct("score")).first()[0] == 1


def test_flat_forest_equals_walked_trees():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > -0.2)).astype(float)
    forest = quality.boost(x, y, trees=20)
    got = quality.probabilities(forest, x)
    assert ((got > 0.5) == y).mean() > 0.95
    for k in range(0, 600, 37):
        raw = forest.base
        for t in range(len(forest.leaf)):
            node = 0
            while node < forest.feature.shape[1]:
                node = 2 * node + 1 + int(x[k, forest.feature[t, node]] > forest.threshold[t, node])
            raw += float(forest.leaf[t, node - forest.feature.shape[1]])
        assert abs(got[k] - 1 / (1 + np.exp(-raw))) < 1e-6


def test_statistics_of_single_texts():
    texts = [r[1] for r in ODD]
    together = quality.statistics(pa.array(texts))
    assert np.array_equal(together, np.concatenate([quality.statistics(pa.array([t], pa.string())) for t in texts]))


def statistics_by_hand(text):
    """The statistics of one text, sign by sign."""
    data = (text or "").encode()
    n, found, spans = max(len(data), 1), [], re.finditer(rb"[^\x20\x09-\x0D]+", data)
    found = [m.group() for m in spans]
    low = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in found]
    some, lines = max(len(found), 1), [x for x in data.split(b"\n") if x]
    share = lambda signs: sum(c in signs for c in data) / n
    upper, digit, symbol = bytes(range(65, 91)), b"0123456789", b"#$%&*@^~_=+<>/\\{}[]"
    return [
        np.log1p(len(data)), np.log1p(len(found)), sum(map(len, found)) / some, share(upper), share(digit), share(b".,;:?"), share(b"!"), share(b"|"), share(symbol), share(b" \t\n\v\f\r"), share(bytes(range(128, 256))),
        sum(a == b for a, b in zip(low, low[1:], strict=False)) / some, len(set(low)) / some, np.log1p(max(map(len, found), default=0)), len(found) / max(len(lines), 1), len(set(lines)) / max(len(lines), 1),
        sum(w[-1] in symbol + b"!" for w in found) / some,
    ]


def test_statistics_equal_brute_force():
    rnd = random.Random(2)
    texts = [r[1] for r in ODD] + ["".join(rnd.choice("ab AB\n12.,!|#é漢 ") for _ in range(rnd.randint(0, 200))) for _ in range(200)]
    assert np.allclose(quality.statistics(pa.array(texts)), np.array([statistics_by_hand(t) for t in texts]), rtol=1e-5)


def test_one_boosting_step_equals_brute_force():
    """The first split is the best of all, and the leaves are the Newton steps on both sides."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 9, size=(300, 4)).astype(np.float32)  # fewer values than bins: every cut is tried
    y = ((x[:, 1] > 4) ^ (rng.random(300) < 0.2)).astype(float)
    forest = quality.boost(x, y, trees=1, depth=1, rate=0.5)
    p = (y.sum() + 1) / (len(y) + 2)
    grad, hess = p - y, np.full(len(y), p * (1 - p))
    best = (-1.0,)
    for f in range(4):
        for cut in np.unique(x[:, f])[:-1]:
            right = x[:, f] > cut
            if min(right.sum(), (~right).sum()) < quality.LEAST_LEAF:
                continue
            value = lambda side: grad[side].sum() ** 2 / (hess[side].sum() + quality.L2)
            best = max(best, (value(right) + value(~right) - value(np.ones(300, bool)), f, cut))
    assert forest.feature[0, 0] == best[1]
    right = x[:, best[1]] > forest.threshold[0, 0]
    assert (right == (x[:, best[1]] > best[2])).all()
    assert np.allclose(forest.leaf[0], [-0.5 * grad[side].sum() / (hess[side].sum() + quality.L2) for side in (~right, right)], rtol=1e-5)


def test_an_id_with_many_texts_teaches_once(spark):
    rows = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(2, "other words")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert quality.fit(rows, labels).base == quality.boost(np.zeros((2, 17), np.float32), np.array([0.0, 1.0])).base


def grams_by_hand(text):
    """Square roots of the counts of the hashed 1- to 3-grams of one text."""
    data = bytearray((text or "").encode())
    for k, c in enumerate(data):
        if c < 128 and not chr(c).isalpha():
            data[k] = 32
        elif 65 <= c <= 90 or (k and data[k - 1] == 0xC3 and 0x80 <= c <= 0x9E and c != 0x97):
            data[k] = c + 32
    out = np.zeros(language.BUCKETS)
    for size in (1, 2, 3):
        for k in range(len(data) - size + 1):
            key = int.from_bytes(data[k : k + size], "big") + (size << 24)
            out[(key * 2654435761 & 0xFFFFFFFF) >> 20] += 1
    return np.sqrt(out)


def test_nearest_centroid_equals_brute_force(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["abc", "cde", "xyz"]), k) for k in range(90)]
    texts = [("".join(rnd.choice(letters + " É") for _ in range(rnd.randint(1, 80))), letters) for letters, _ in rows]
    model = language.fit(spark.createDataFrame(texts, "text string, lang string"))
    used = sorted({t for t, _ in texts if any(c.isalpha() for c in t)})
    tf = np.array([grams_by_hand(t) for t in used])
    assert np.allclose(model.idf, np.log((1 + len(used)) / (1 + (tf > 0).sum(axis=0))) + 1, rtol=1e-5)
    centroids = model.weights / model.idf[:, None]
    assert np.allclose(np.linalg.norm(centroids, axis=0), 1, atol=1e-4)
    tried = [t for t, _ in texts] + ["hello", "1", ""]
    lang, cosine, rejected = language.score(model, pa.array(tried))
    for k, t in enumerate(tried):
        if not any(c.isalpha() for c in t):
            assert lang[k] == -1 and rejected[k]
            continue
        x = grams_by_hand(t) * model.idf
        near = centroids.T @ x / np.linalg.norm(x)
        assert abs(cosine[k] - near.max()) < 1e-4 and near[model.owner == lang[k]].max() > near.max() - 1e-4
        assert rejected[k] == (cosine[k] < model.least[lang[k]] * np.sqrt(min(1, len(t.encode()) / language.FULL_BYTES)))


def test_copies_crowd_out_no_language(spark):
    """A label of many copies is learnt, and copies leave room for a language's other texts."""
    rows = [("der schnelle braune Fuchs springt", "de")] * 100 + [(f"the quick brown fox number {k} jumps", "en") for k in range(300)] + [("12345", "none")] * 5
    df = spark.createDataFrame(rows + [(f"le renard brun {k}", "fr") for k in range(30)] + [("le même renard", "fr")] * 400, "text string, lang string")
    for size in (1, 20):
        assert language.fit(df, sample_per_language=size).languages == ["de", "en", "fr"]
    taken = language.sampled(df, "text", "lang", 20).toPandas()
    assert taken.groupby("label").text.nunique().to_dict() == {"de": 1, "en": 20, "fr": 20} and len(taken) == 41
