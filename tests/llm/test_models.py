"""Classifiers by held-out accuracy, search by recall, the pipeline by parts."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from fixtures import empty, frame, prose
from pyspark.sql import functions as F

import corpus_pipeline
from sightline.llm import additive_search, common, language_id, quality_crf
from sightline.llm.common import text_buffers

SYLLABLES = {"aa": "ka lo mi tu ra".split(), "bb": "schen ung ich der".split(), "cc": "çao ñes ión que".split()}


def speak(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_language_id(spark):
    rng = random.Random(3)
    langs = [rng.choice(list(SYLLABLES)) for _ in range(400)]
    data = [(i, speak(rng, x, rng.randint(3, 60)), x) for i, x in enumerate(langs)]
    data += [(1000, None, "aa"), (1001, "12 34 ..", "bb"), (1002, "", None), (None, speak(rng, "aa", 30), "aa"), (5, data[5][1], data[5][2])]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = language_id.predict(spark, docs, language_id.fit(docs, language_id.learnable())).select("_row.*", "lang_pred", "score", language_id.held_out().alias("held")).collect()
    assert len(got) == len(data) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held and r.doc_id < 1000]
    assert len(held) > 40 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert {r.lang_pred for r in got if r.doc_id in (1000, 1001, 1002)} == {"und"}
    nothing = language_id.predict(spark, docs, language_id.fit(docs, F.lit(False)))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    kept = language_id.keep_known(spark, docs)
    assert kept.columns == docs.columns and len(data) - 15 < kept.count() <= len(data) - 3
    assert language_id.predict(spark, empty(spark), None).count() == 0


def test_language_id_learns_rare_languages(spark):
    import pyarrow as pa

    rng = random.Random(2)
    data = [(3 * k + j, speak(rng, "aa", 20), f"l{k:03}") for k in range(230) for j in range(2)]
    data += [(9000, speak(rng, "bb", 30), "zz")]
    model = language_id.fit(spark.createDataFrame(data, "doc_id long, text string, lang string"), F.col("doc_id").isNotNull())
    assert model.langs == [*(f"l{k:03}" for k in range(230)), "zz"]
    flags = language_id.presence(*text_buffers(pa.array([speak(rng, "bb", 30)])))
    assert model.langs[int(model.scores(flags).argmax())] == "zz"


def grams(text):
    """The hashed n-grams of a text, one by one."""
    data, out = text.encode(), set()
    data = bytes(c + 32 if 65 <= c <= 90 else c for c in data)
    for n in (1, 2, 3):
        for i in range(len(data) - n + 1):
            code = 0
            for c in data[i : i + n]:
                code = (code * 257 + c + 1) % 2**32
            out.add(code * (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)[n - 1] % 2**32 >> 18)
    return out


def test_presence_is_the_set_of_ngrams(monkeypatch):
    import pyarrow as pa

    texts = ["abcab", "ABCAB", "", "cab", "é ü 漢字", "x", "long " * 500]
    x = language_id.presence(*text_buffers(pa.array(texts)))
    assert [set(np.flatnonzero(r).tolist()) for r in x] == [grams(t) for t in texts]


def test_language_scores_are_kernel_ridge_regression(spark):
    rng = random.Random(11)
    data = [(i, speak(rng, x, rng.randint(2, 30)), x) for i, x in enumerate(rng.choices(list(SYLLABLES), [6, 3, 1], k=180))]
    data = [*data, (900, "Ⅷ ² ½ ①", "aa"), (901, "日本 " * 20_000, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").select("*", F.lit(1).alias("score"), F.lit("q").alias("lang_pred"), F.lit(0).alias("_row"))
    model = language_id.fit(docs, language_id.learnable())
    got = {r["_row"]["doc_id"]: (r.lang_pred, r.score) for r in language_id.predict(spark, docs, model).collect()}
    kernel = lambda a, b: len(a & b) / np.sqrt(max(len(a), 1) * max(len(b), 1))
    own = sorted((x, str(i), t) for i, t, x in data if x is not None and i < 900 and zlib.crc32(str(i).encode()) % 5 != 0)
    own += [("aa", "900", data[-2][1])] if zlib.crc32(b"900") % 5 else []
    own.sort()
    sets, langs = [grams(t) for _, _, t in own], sorted({x for x, _, _ in own})
    per = language_id.LANDMARKS // len(langs)
    marks = [g for k in langs for g in [s for s, (x, _, _) in zip(sets, own, strict=True) if x == k][:per]]
    kmm = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(kmm)
    root = vectors[:, values > 1e-6 * values.max()] / np.sqrt(values[values > 1e-6 * values.max()])
    z = np.array([[kernel(a, b) for b in marks] for a in sets]) @ root
    label = np.array([langs.index(x) for x, _, _ in own])
    weight = len(label) / len(langs) / np.bincount(label)[label]
    y = np.where(label[:, None] == np.arange(len(langs)), 1.0, -1.0)
    mean, centre = z.mean(axis=0), 2 / len(langs) - 1
    zc = z - mean
    a = np.linalg.solve(zc.T @ (weight[:, None] * zc) + language_id.RIDGE * len(label) * np.eye(z.shape[1]) / z.shape[1], zc.T @ (weight[:, None] * (y - centre)))
    for i, t, _ in data[:-2]:
        s = (np.array([kernel(grams(t), b) for b in marks]) @ root - mean) @ a + centre
        assert got[i][0] == langs[int(s.argmax())] and abs(got[i][1] - min(1, max(0, (s.max() - centre) / (1 - centre)))) < 1e-2
    assert got[900] == ("und", 0.0) and got[901][0] in langs


def junk(rng):
    kind = rng.randrange(3)
    w = prose(rng, rng.randint(40, 120)).split()
    if kind == 0:
        return " ".join(x + rng.choice(["***", "###", "$$$"]) for x in w)
    if kind == 1:
        return " ".join(x.upper() + "!!" for x in w)
    return " ".join(x for x in w[:8] for _ in range(15))


def labelled(spark, n=500):
    rng = random.Random(6)
    quality = [int(rng.random() < 0.7) for _ in range(n)]
    docs = [(i, prose(rng, rng.randint(30, 150)) if q else junk(rng)) for i, q in enumerate(quality)]
    docs += [(9000, None), (9001, ""), (9002, " \n "), (None, "x"), (7, docs[7][1])]
    labels = [(i, q) for i, q in enumerate(quality)] + [(3, 1 - quality[3]), (None, 1), (8000, 1), (5, None)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), quality


def test_quality_crf(spark):
    docs, labels, quality = labelled(spark)
    model = quality_crf.fit(docs, labels, F.col("doc_id").isNotNull() & ~quality_crf.held_out())
    got = quality_crf.score(spark, docs, model).withColumn("held", quality_crf.held_out()).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    held = [(r.score >= 0.7, quality[r.doc_id] == 1) for r in got if r.held and r.doc_id < 500]
    assert len(held) > 80 and np.mean([a == b for a, b in held]) > 0.95
    assert {r.score for r in got if r.doc_id in (9000, 9001, 9002)} == {0.0}
    lines = quality_crf.label_lines(spark, docs.where("doc_id < 20"), model).collect()
    assert all(0 <= r.p_good <= 1 for r in lines) and len({(r.doc_id, r.line) for r in lines}) <= len(lines)
    assert quality_crf.fit(docs, labels.limit(0), F.lit(True)) is None
    assert {r.score for r in quality_crf.score(spark, docs, None).collect()} == {0.0}
    assert quality_crf.score(spark, docs.limit(0), model).count() == 0


def line_features(text):
    """Own features of every line with a word, and its length, one by one."""
    out, seen = [], set()
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        w = re.findall(r"[^\x20\x09-\x0D]+", line)
        if w:
            data = line.encode()
            kinds = ["#*$%&<>@^~=\\/{}[]", "|", "!?", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", None, ".,;:"]
            shares = [sum(c >= 128 if k is None else chr(c) in k and c < 128 for c in data) / len(data) for k in kinds]
            same = sum(a == b for a, b in zip(w, w[1:])) / len(w)
            size = sum(len(x.encode()) for x in w) / len(w)
            own = [math.log1p(len(data)) / 8, math.log1p(len(w)) / 6, same, 1 - len(set(w)) / len(w), min(size / 16, 2), len(w) == 1, tuple(w) in seen, *[min(4 * s, 2) for s in shares]]
            seen.add(tuple(w))
            out.append((len(data), [float(v) for v in own]))
    return out


def test_features_and_document_scores(spark):
    rng = random.Random(12)
    texts = [prose(rng, 60), "One.\nOne.\n\nTWO two two | | x\n é ü!? 12\n", "", None, "x" * 30_000 + "\n" + "a b\n" * 3_000, junk(rng)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("*", F.lit(2).alias("score"), F.lit(3).alias("q"), F.lit("x").alias("quality"))
    wide = np.random.default_rng(1)
    model = quality_crf.Model(wide.normal(size=quality_crf.WIDTH) * 0.3, wide.normal(size=(2, 2)) * 0.5, 1.3, -0.2)
    got = {r.doc_id: r.score for r in quality_crf.score(spark, docs, model).collect()}
    for i, t in enumerate(texts):
        rows = line_features(t or "")
        if not rows:
            assert got[i] == 0
            continue
        own = np.array([f for _, f in rows])
        pad = np.zeros((1, own.shape[1]))
        x = np.concatenate([np.ones((len(own), 1)), own, np.concatenate([pad, own[:-1]]), np.concatenate([own[1:], pad])], axis=1)
        emit = x @ model.weights
        # The chain's sums, state by state.
        forward, back = np.zeros((len(x), 2)), np.zeros((len(x), 2))
        for k in range(len(x)):
            for s in (0, 1):
                before = [forward[k - 1, r] + model.moves[r, s] for r in (0, 1)] if k else [0.0, -np.inf]
                forward[k, s] = s * emit[k] + np.logaddexp(*before)
        for k in range(len(x) - 2, -1, -1):
            for s in (0, 1):
                back[k, s] = np.logaddexp(*[model.moves[s, r] + r * emit[k + 1] + back[k + 1, r] for r in (0, 1)])
        both = forward + back
        good = np.exp(both[:, 1] - np.logaddexp(both[:, 0], both[:, 1]))
        size = np.array([n for n, _ in rows])
        mean = min(max((good * size).sum() / size.sum(), 1e-4), 1 - 1e-4)
        assert abs(got[i] - 1 / (1 + math.exp(-(1.3 * math.log(mean / (1 - mean)) - 0.2)))) < 1e-4
    labels = spark.createDataFrame([(0, 1), (4, 0), (5, 0)], "doc_id long, quality int")
    assert quality_crf.fit(docs, labels, F.lit(True)) is not None  # with every line of the long one


def test_forward_backward_is_enumeration():
    rng = np.random.default_rng(0)
    row = np.array([0, 0, 0, 1, 2, 2])
    x = rng.normal(size=(6, quality_crf.WIDTH))
    model = quality_crf.Model(rng.normal(size=quality_crf.WIDTH) * 0.2, rng.normal(size=(2, 2)))
    got, pairs = model.marginals(x, row, pairs=True)
    emit = x @ model.weights
    want, joint = np.zeros(6), np.zeros((2, 2))
    for r in range(3):
        at = np.flatnonzero(row == r)
        total = 0.0
        marg, both = np.zeros(len(at)), np.zeros((2, 2))
        for bits in np.ndindex(*[2] * len(at)):
            w = math.exp(sum(emit[i] for i, b in zip(at, bits, strict=True) if b) + sum(model.moves[a, b] for a, b in zip(bits, bits[1:])))
            total += w
            marg += w * np.array(bits)
            for a, b in zip(bits, bits[1:]):
                both[a, b] += w
        want[at], joint = marg / total, joint + both / total
    assert np.allclose(got, want) and np.allclose(pairs, joint)


def vectors(spark, n=1500, d=16):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x[100:160] = x[100]  # copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [None, [0.0] * d, [float("nan")] + [1.0] * (d - 1), [None] + [1.0] * (d - 1), [float("inf")] + [1.0] * (d - 1), [1.0], []]
    rows += [(n + i, b) for i, b in enumerate(bad)] + [(None, x[0].tolist())]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>"), x.astype(float)


def test_additive_search(spark):
    v, x = vectors(spark)
    got = additive_search.search(spark, v, F.col("vec_id") % 50 == 0).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hits = total = 0
    for q in range(0, 1500, 50):
        cos = np.array([(a * x[q]).sum() / np.sqrt((a * a).sum()) / np.sqrt((x[q] * x[q]).sum()) for a in x])
        cos[q] = -9
        best = np.lexsort((np.arange(len(x)), -cos))[:5]
        mine = [found[q][k] for k in range(1, 6)]
        assert all(abs(s - cos[i]) < 1e-12 for i, s in mine) and mine == sorted(mine, key=lambda t: (-t[1], t[0]))
        hits += len(set(best) & {i for i, _ in mine})
        total += 5
    assert sorted(found) == list(range(0, 1500, 50)) and hits / total > 0.95
    assert [i for i, _ in (found[100][k] for k in range(1, 6))] == [101, 102, 103, 104, 105]
    few = additive_search.search(spark, v.where("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert len(few) == 2
    assert additive_search.search(spark, v.limit(0), F.lit(True)).count() == 0
    assert additive_search.search(spark, v, F.lit(False)).count() == 0


def test_additive_search_is_whole_in_dense_groups(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 16))
    x[1000:] = x[0] + rng.normal(size=(2000, 16)) * 1e-5  # more rows of close codes than a shortlist
    ids = np.arange(3000)
    ids[1500:2100] = 1500  # repeats of one id
    v = spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = {}
    for r in additive_search.search(spark, v, (F.col("vec_id") % 100 == 0) & (F.col("vec_id") != 1500)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    assert len(got) == 24
    for q, found in got.items():
        cos = np.where(ids == q, -9, unit @ unit[q])
        assert [i for _, i in sorted(found)] == ids[np.lexsort((ids, -cos))[:5]].tolist()


def test_joint_fit_lowers_the_error():
    rng = np.random.default_rng(3)
    x = additive_search._unit(rng.normal(size=(900, 12)) @ rng.normal(size=(12, 12)))
    plain, joint = (additive_search.train(x, 4, 16, fits=f) for f in (0, 2))
    error = lambda b: ((x - b.decode(b.encode(x))) ** 2).sum()
    assert error(joint) < 0.97 * error(plain)
    codes = plain.encode(x)
    words = additive_search.fitted(x, codes, plain.words, 400)
    # The fit is the least-squares solution of all codewords together.
    a = np.zeros((len(x), 64))
    for m in range(4):
        a[np.arange(len(x)), 16 * m + codes[:, m]] = 1
    best = x - a @ np.linalg.lstsq(a, x, rcond=None)[0]
    assert ((x - additive_search.Codebooks(words).decode(codes)) ** 2).sum() < 1.001 * (best**2).sum()


@pytest.mark.parametrize("n", [10_000, 40_000])
def test_recall_at_sizes(spark, n, monkeypatch):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n // 20, 24))[rng.integers(0, n // 20, n)] + 0.3 * rng.normal(size=(n, 24))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = additive_search.search(spark, v, F.col("vec_id") % 500 == 0).collect()
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, n, 500):
        cos = unit @ unit[q]
        cos[q] = -9
        hits += len(found[q] & set(np.argpartition(-cos, 5)[:5].tolist()))
    assert hits / (5 * len(range(0, n, 500))) >= 0.95


def test_additive_search_in_many_blocks_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(additive_search, "CODE_BLOCK", 100)
    monkeypatch.setattr(additive_search, "QUERY_BLOCK", 7)
    monkeypatch.setattr(additive_search, "GROUPS", 3)
    v, x = vectors(spark)
    v = v.select("*", F.lit(1).alias("rank"), F.lit("x").alias("score"), F.lit(2).alias("_block"), F.lit(3).alias("codes"))
    got = {}
    for r in additive_search.search(spark, v, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    for q, found in got.items():
        cos = (unit * unit[q]).sum(axis=1)
        cos[q] = -9
        assert [found[k] for k in range(1, 6)] == np.lexsort((np.arange(len(x)), -cos))[:5].tolist()
    assert len(got) == 30


def test_cosine_of_huge_components(spark):
    v = spark.createDataFrame([(0, [1e200, 2e200]), (1, [2e200, 4e200]), (2, [1e-200, 0.0])], "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r.vec_id, round(r.score, 12)) for r in additive_search.search(spark, v, F.col("vec_id") == 0).collect())
    assert got == [(1, 1, 1.0), (2, 2, round(1 / 5**0.5, 12))]


def pipeline_documents(spark, folder):
    """Prose in three languages, foreign text, junk, copies; labels of some."""
    rng = random.Random(9)
    out = [(prose(rng, 120), "en") for _ in range(30)] + [(speak(rng, "cc", 120), "es") for _ in range(10)] + [(speak(rng, "bb", 120), "de") for _ in range(20)]
    out += [out[0], (out[1][0].replace(".", ",", 1), "en"), (out[45][0], "de")]
    out += [("12 34", "en"), (None, "en"), ("", None), ("too short", "en"), ("漢字かな交じり文 " * 40, None)] + [(junk(rng), "en") for _ in range(16)]
    docs = spark.createDataFrame([(3 * i, t, x, f"s{i % 2}", len(t or "")) for i, (t, x) in enumerate(out)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(3 * i, int(i < 68), 0) for i in range(len(out)) if i < 60 or i >= 68]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs, out


def test_pipeline(spark, tmp_path):
    docs, out = pipeline_documents(spark, tmp_path)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "ngram_join", "packing"]
    stage, kept = docs, []
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, str(tmp_path))
        assert stage.columns == docs.columns
        kept.append({r.doc_id for r in stage.collect()})
    clean = {3 * i for i in range(63)}
    assert clean <= kept[0] and not kept[0] & {3 * i for i in (63, 64, 65, 67)}  # no letter, no text, another script
    assert kept[1] == clean
    assert kept[2] == {3 * i for i in range(60)}
    before = common.made()
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert common.made() == before + len(corpus_pipeline.STAGES)  # the stages' own tables
    assert {r.doc_id for r in pieces} == kept[2]
    assert Counter(r.doc_id for r in pieces if r.start == 0).most_common(1)[0][1] == 1


def test_pipeline_on_an_empty_table(spark, tmp_path):
    docs, _ = pipeline_documents(spark, tmp_path / "some")
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(str(tmp_path / "some/labels.parquet")).limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_language_stage_takes_languages_and_scores(spark, tmp_path):
    docs, out = pipeline_documents(spark, tmp_path)
    only = {r.doc_id for r in language_id.keep_known(spark, docs, langs=["de"]).collect()}
    assert {3 * i for i in range(40, 60)} <= only and not only & {3 * i for i in range(40)}
    assert language_id.keep_known(spark, docs, min_score=1.1).count() == 0
    nothing = docs.withColumn("lang", F.lit(None).cast("string"))  # nothing to learn: no verdict
    assert language_id.keep_known(spark, nothing).count() == sum(any(c.isalpha() for c in t or "") for t, _ in out)


def test_queries_are_registered():
    pytest.importorskip("sightline.llm")
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
