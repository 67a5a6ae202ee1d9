"""Operators over documents against brute force, edge cases included."""

import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import empty, frame, prose, texts
from pyspark.sql import functions as F

from sightline.llm import byte_bpe, license_scan, ngram_join, packing, quality_rules, sentence_pieces, token_counts, training_order
from sightline.llm.common import shared_path


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).repartition(3).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(byte_bpe.default_path())


def test_token_counts(spark, docs, rows, library):
    path = shared_path(spark, "cache")
    want = Counter((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in rows)
    half = docs.where("doc_id % 2 = 0")
    token_counts.count_tokens(spark, half, path)
    assert spark.read.parquet(path).count() == len({r.text or "" for r in rows if r.doc_id is not None and r.doc_id % 2 == 0})
    for _ in range(2):  # a partly warm cache, then one that has everything
        got = token_counts.count_tokens(spark, docs, path).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
        assert spark.read.parquet(path).count() == len({r.text or "" for r in rows})
    assert token_counts.count_tokens(spark, empty(spark), shared_path(spark, "cache")).count() == 0


def test_token_counts_query_keeps_its_cache(spark, docs, rows, library, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "shared_root", lambda spark: str(tmp_path / "shared"))
    want = Counter((r.doc_id, len((r.text or "").encode()), n := len(library.encode(r.text or "", add_special_tokens=False).ids), n > 512) for r in rows)
    docs.where("doc_id > 60").write.parquet(str(tmp_path / "a/documents.parquet"))
    docs.write.parquet(str(tmp_path / "b/documents.parquet"))
    token_counts.op9_token_counts(spark, str(tmp_path / "a")).collect()
    cold = spark.read.parquet(str(tmp_path / "shared/token-counts/*")).count()
    for _ in range(2):
        got = token_counts.op9_token_counts(spark, str(tmp_path / "b")).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
        assert cold < spark.read.parquet(str(tmp_path / "shared/token-counts/*")).count() == len({r.text or "" for r in rows})


def test_token_counts_with_one_content_in_a_third_of_all_rows(spark, library):
    d = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'the same text', concat('text ', id)) AS text").repartition(7)
    got = token_counts.count_tokens(spark, d, shared_path(spark, "cache"))
    assert got.count() == 3000 and got.where(F.col("doc_id") % 3 == 0).select("n_tokens").distinct().collect()[0][0] == len(library.encode("the same text").ids)
    # The frequent content's counts come by broadcast, not through the shuffle of the others.
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()


def test_packing(spark, docs, rows, library):
    got = packing.pack(spark, docs).collect()
    ids = defaultdict(list)
    for r in rows:
        ids[r.doc_id].append([*library.encode(r.text or "", add_special_tokens=False).ids, 0])
    pieces = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got)
    want = Counter((d, at, len(x[at : at + 1024]), zlib.crc32(np.array(x[at : at + 1024], "<u4").tobytes()), len(x)) for d, all_ in ids.items() for x in all_ for at in range(0, len(x), 1024))
    assert pieces == want
    placed = defaultdict(list)
    for r in got:
        placed[r.sequence_id].append((r.offset, r.length))
    for spans in placed.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))] and sum(n for _, n in spans) <= 1024
    assert sorted(placed) == list(range(len(placed)))
    assert packing.pack(spark, empty(spark)).count() == 0


def test_plan_fills_windows():
    rng = np.random.default_rng(2)
    tokens = rng.lognormal(6.5, 1.0, 20_000).astype(int) + 1
    histogram = np.bincount(tokens % 1024, minlength=1025)  # what cut() leaves
    histogram[0], histogram[1024] = 0, (tokens // 1024).sum()
    made = packing.plan(histogram)
    used = Counter()
    for lengths, n in made:
        assert sum(lengths) <= 1024
        for x in lengths:
            used[x] += n
    assert all(used[x] == histogram[x] for x in range(1, 1025))
    total = sum(n for _, n in made)
    assert (histogram * np.arange(1025)).sum() / (total * 1024) > 0.995


def brute_components(rows):
    sets, parent = [], list(range(len(rows)))
    for r in rows:
        w = words(lower(r.text))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[root(i)].append(r.doc_id)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return Counter((r.doc_id, len(sets[i]), least[root(i)] if sets[i] else r.doc_id) for i, r in enumerate(rows))


def test_ngram_join(spark, docs, rows):
    got = ngram_join.link_components(spark, docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows)
    assert ngram_join.link_components(spark, empty(spark)).count() == 0


def test_ngram_join_many_near_copies(spark):
    import random

    rng = random.Random(5)
    base = prose(rng, 150).split(" ")
    out = []
    for k in range(330):  # more than a block; each pair links or not by chance
        w = list(base)
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**9)}"
        out.append(" ".join(w))
    d = frame(spark, out)
    got = ngram_join.link_components(spark, d).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(d.collect())


def test_ngram_join_counts_all_links(spark, docs, rows):
    import random

    rng = random.Random(7)
    base = prose(rng, 150).split(" ")
    out = []
    for _ in range(700):  # three blocks of one component, and a few exact copies
        w = list(base)
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**9)}"
        out.append(" ".join(w))
    many = frame(spark, out + out[:5])
    for d, own in ((docs, rows), (many, many.collect())):
        number = {}
        sets = []
        for r in own:
            w = words(lower(r.text))
            grams = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
            sets.append([number.setdefault(g, len(number)) for g in grams])
        x = np.zeros((len(sets), len(number)), dtype=np.float32)
        for i, s in enumerate(sets):
            x[i, s] = 1
        both, size = x @ x.T, x.sum(axis=1)
        linked = (both > 0) & (100 * both >= 80 * (size[:, None] + size[None, :] - both))
        np.fill_diagonal(linked, False)
        got = ngram_join.link_components(spark, d, count=True).collect()
        assert Counter((r.doc_id, r.n_links) for r in got) == Counter((r.doc_id, n) for r, n in zip(own, linked.sum(axis=1).tolist(), strict=True))
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link_components(spark, d).collect())


def test_keep_one(spark, docs, rows):
    kept = ngram_join.keep_one(spark, docs)
    assert kept.columns == docs.columns
    want = {c for d, n, c in brute_components(rows)}
    assert Counter(r.doc_id for r in kept.collect() if r.doc_id is not None) == Counter(x for x in want if x is not None)


def test_rows_that_repeat_an_id(spark):
    import random

    rng = random.Random(21)
    a, b, c = (prose(rng, 90) for _ in range(3))
    near = lambda t: " ".join([*t.split()[:-1], "changed"])
    rows = [(1, a), (1, b), (5, near(a)), (6, near(b)), (6, near(b)), (None, c), (None, near(c)), (None, near(c)), (9, "alone one"), (9, "alone one"), (8, ""), (8, ""), (8, None), (None, None)]
    d = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, _row int").repartition(3)
    got = ngram_join.link_components(spark, d, count=True).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(d.collect())
    kept = Counter((r.doc_id, r.text) for r in ngram_join.keep_one(spark, d).collect())
    least = kept.pop((None, c), 0) + kept.pop((None, near(c)), 0)
    assert least == 1 and kept == Counter({(1, a): 1, (1, b): 1, (9, "alone one"): 1, (8, ""): 2, (8, None): 1, (None, None): 1})


def test_one_content_in_a_third_of_all_rows(spark):
    import random

    rng = random.Random(22)
    base = prose(rng, 60)
    d = spark.createDataFrame([(i, base if i % 3 == 0 else prose(rng, 20)) for i in range(900)], "doc_id long, text string").repartition(8)
    got = ngram_join.link_components(spark, d)
    assert got.where("component_id = 0").count() == 300 and got.count() == 900
    # Rows of a frequent class get their component by broadcast, the others by a shuffle.
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("LeftAnti") >= 1
    assert ngram_join.keep_one(spark, d).count() == 601


def test_sketch_adds_up_in_steps(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SKETCH_TASKS", 2)
    keys = np.arange(1, 5001, dtype=np.uint64) % np.uint64(97)
    d = spark.createDataFrame([(keys[k::9].tobytes(),) for k in range(9)], "hashes binary").repartition(9)
    n = np.bincount(keys.astype(np.int64), minlength=ngram_join.SKETCH)
    assert (ngram_join._sketch(d) == np.ceil(np.log2(n + 1))).all()


def test_key_filter(spark):
    from sightline.llm.common import key_filter, maybe_in

    rng = np.random.default_rng(2)
    keys = rng.integers(-(2**63), 2**63 - 1, 5000)
    table = key_filter(spark.createDataFrame([(int(k),) for k in keys], "k long"), 5000)
    assert maybe_in(table, keys).all() and maybe_in(table, rng.integers(-(2**63), 2**63 - 1, 20_000)).mean() < 0.1
    assert not maybe_in(key_filter(spark.createDataFrame([], "k long"), 0), keys).any()


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    from sightline.llm.common import shared_root

    session = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="spark://x:7077"))
    with pytest.raises(ValueError):
        shared_root(session)
    session.conf["spark.checkpoint.dir"] = "/shared/"
    assert shared_root(session) == "/shared/sightline"


def test_quality_rules(spark, docs, rows):
    got = quality_rules.rules(docs).select("_row.doc_id", "_row.score", *quality_rules.COUNTS, "base_failed", "kept", "llr").collect()
    want = Counter()
    for r in rows:
        w, seen, dup, cover = words(r.text), set(), 0, set()
        for line in (r.text or "").split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        count = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        for i in range(len(w) - 2):
            if count[tuple(w[i : i + 3])] > 1:
                cover |= {i, i + 1, i + 2}
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        want[(r.doc_id, r.score, len(w), sum(map(len, w)), sum((r.text or "").count(c) for c in "#*$%&|<>"), dup, len(cover), failed)] += 1
    assert Counter((r.doc_id, r.score, *(r[c] for c in quality_rules.COUNTS), r.base_failed) for r in got) == want
    assert all(not r.kept for r in got if r.base_failed)
    assert all(r.kept == (not r.base_failed and r.llr >= quality_rules.MIN_LLR) for r in got)
    assert quality_rules.keep_good(docs).columns == docs.columns
    assert quality_rules.rules(empty(spark)).count() == 0


def test_log_likelihood_ratio(spark):
    import random

    rng = random.Random(4)
    good = [prose(rng, 100) for _ in range(60)]
    junk = [" ".join(w + rng.choice(["***", "$$$", "&&&"]) for w in prose(rng, 100).split()) for _ in range(15)]
    d = frame(spark, good + junk)
    kept = {r.doc_id for r in quality_rules.keep_good(d).collect()}
    assert {3 * i for i in range(60)} == {k for k in kept if k is not None and k < 180}
    assert not any(k >= 180 for k in kept if k is not None and k != 39)


def brute_llr(rows, trusted, hashes):
    """The mean ratio of every row. ``hashes``: the engine's hash of a tuple of
    words, or of hashes, as the plan takes it."""
    grams = []
    for r in rows:
        h = [hashes(w) for w in words(r.text)]
        grams.append([x & (quality_rules.BUCKETS - 1) for x in h] + [(hashes(a, b) & (quality_rules.BUCKETS - 1)) + quality_rules.BUCKETS for a, b in zip(h, h[1:])])
    raw, target = Counter(), Counter()
    for r, g in zip(rows, grams, strict=True):
        raw.update(g)
        if r.doc_id in trusted:
            target.update(g)
    share = sum(target.values()) / sum(raw.values())
    ratio = {b: round(1000 * math.log((target[b] + 20 * share) / (raw[b] + 20) / share)) for b in raw}
    return [sum(ratio[b] for b in g) / (1000 * max(1, len(g))) for g in grams]


def test_ratio_is_brute_force(spark, docs, rows):
    seen: dict = {}

    def hashes(*parts):
        return seen[parts]

    vocabulary = sorted({w for r in rows for w in words(r.text)})
    for r in spark.createDataFrame([(w,) for w in vocabulary], "w string").select("w", F.xxhash64("w").alias("h")).collect():
        seen[(r.w,)] = r.h
    pairs = sorted({(seen[(a,)], seen[(b,)]) for r in rows for a, b in zip(words(r.text), words(r.text)[1:])})
    for r in spark.createDataFrame(pairs, "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("h")).collect():
        seen[(r.a, r.b)] = r.h
    labels = spark.createDataFrame([(r.doc_id, int(r.doc_id < 60)) for r in rows if r.doc_id is not None] + [(3, 0), (None, 1), (6, None)], "doc_id long, quality int")
    trusted = quality_rules.trusted_ids(labels)
    ids = {r.doc_id for r in trusted.collect()}
    assert ids == {r.doc_id for r in rows if r.doc_id is not None and r.doc_id < 60 and r.doc_id != 3 and zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    assert 0 < quality_rules.trusted_ids(labels, 4).count() < len(ids)
    got = quality_rules.rules(docs, trusted).select("_row.doc_id", F.col("_row.text").alias("text"), "llr", "kept", "base_failed").collect()
    want = Counter((r.doc_id, r.text, round(x, 9)) for r, x in zip(rows, brute_llr(rows, ids, hashes), strict=True))
    assert Counter((r.doc_id, r.text, round(r.llr, 9)) for r in got) == want
    assert all(r.kept == (not r.base_failed and r.llr >= quality_rules.MIN_LLR) for r in got)
    nobody = spark.createDataFrame([(10**9,)], "doc_id long")  # then the rule says whom to trust
    assert quality_rules.fit(docs, nobody) == quality_rules.fit(docs)


def test_rules_on_labelled_documents(spark):
    import random

    rng = random.Random(14)
    good = [prose(rng, 80) for _ in range(120)]
    bad = [" ".join(w + rng.choice(["***", "$$$"]) for w in prose(rng, 80).split()) for _ in range(40)]
    d = frame(spark, good + bad).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    labels = spark.createDataFrame([(3 * i, int(i < 120)) for i in range(160)], "doc_id long, quality int")
    held = lambda i: zlib.crc32(str(3 * i).encode()) % 4 == 2
    kept = {r.doc_id for r in quality_rules.keep_good(d, quality_rules.trusted_ids(labels)).collect()}
    assert all(3 * i in kept for i in range(120) if held(i)) and not any(3 * i in kept for i in range(120, 160))


def test_license_scan(spark, docs):
    mit = license_scan.TEMPLATES["MIT"][2]
    w = mit.split()
    changed = " ".join("other" if i % 40 == 7 else x for i, x in enumerate(w))
    worse = " ".join("other" if i % 12 == 7 else x for i, x in enumerate(w))
    comment = "\n".join(" * " + line for line in license_scan.TEMPLATES["BSD-3-Clause"][0].lower().split(". "))
    notes = [
        "Hello.\nReleased under the MIT License\nBye",
        "some words before " + mit + " and after",
        changed,
        worse,
        " ".join(w[::-1]),
        "So is THIS WORK is licensed under the GNU General Public License, version 3, and so on",
        "/*\n" + comment + "\n*/",
        "Licensed under the Apache License, Version 2.0; or else",
        "the word " * 5_000 + license_scan.TEMPLATES["Zlib"][0],
        license_scan.TEMPLATES["GPL-3.0"][0] + license_scan.TEMPLATES["Unlicense"][0],
    ]
    d = docs.select("doc_id", "text", F.lit(1).alias("template"), F.lit("x").alias("license_id")).unionByName(
        spark.createDataFrame([(900 + i, t, 1, "x") for i, t in enumerate(notes)], "doc_id long, text string, template int, license_id string")
    )
    got = {(r.doc_id, r.license_id, r.template, r.n_matched, r.n_shingles, r.first_word) for r in license_scan.scan(spark, d).collect()}
    numbered = [(n, set(s)) for n, all_ in sorted(license_scan.TEMPLATES.items()) for s in map(license_scan.shingles, all_) if s]
    want = set()
    for r in d.collect():
        own = license_scan.shingles(r.text or "")
        for k, (name, s) in enumerate(numbered):
            both = s & set(own)
            if len(both) >= 0.8 * len(s):
                want.add((r.doc_id, name, k, len(both), len(s), min(own.index(x) for x in both)))
    assert got == want
    names = {i: {n for d, n, *_ in got if d == 900 + i} for i in range(10)}
    assert names[0] == names[1] == names[2] == {"MIT"} and not names[3] and not names[4] and "GPL-3.0" in names[5]
    assert {"BSD-3-Clause"} <= names[6] and names[7] == {"Apache-2.0"} and names[8] == {"Zlib"} and {"GPL-3.0", "Unlicense"} <= names[9]
    assert license_scan.scan(spark, empty(spark)).count() == 0
    assert license_scan.scan(spark, d, {}).count() == 0


def test_every_license_is_found_with_words_changed(spark):
    import random

    rng = random.Random(8)
    texts_ = []
    for name, all_ in sorted(license_scan.TEMPLATES.items()):
        for t in all_:
            w = t.split()
            n = len(license_scan.shingles(t))
            for i in rng.sample(range(len(w)), n // 25):  # each breaks five shingles at most
                w[i] = "changed"
            texts_.append((name, " ".join(w)))
    d = spark.createDataFrame([(i, prose(rng, 30) + t) for i, (_, t) in enumerate(texts_)], "doc_id long, text string")
    found = {(r.doc_id, r.license_id) for r in license_scan.scan(spark, d).collect()}
    assert {(i, n) for i, (n, _) in enumerate(texts_)} <= found


def pieces_of(m, text, size):
    chunks = [c for _, c in sentence_pieces.split(m, text, size)]
    states = [sentence_pieces.transfer(m, c) for c in chunks]
    out = []
    for c, (entry, exit_, _), (i, j) in zip(chunks, states, sentence_pieces._scan(states), strict=True):
        out += sentence_pieces.trace(m, c, entry[i], exit_[j])
    return out


@pytest.mark.parametrize("size", [17, 33, 100])
def test_scan_is_the_library(size):
    m = sentence_pieces.load(sentence_pieces.default_path())
    cases = [t[:600] for t in texts() if t] + ["abcabcabc" * 30, "  x  y   z" * 20, "日本語" * 30, "x😀y" * 30, "trail   ", "▁▁ a▁b" * 10, "0123456789" * 20]
    for t in cases:
        assert pieces_of(m, t, size) == m.encode(t)
        assert m.decode(m.encode(t)) == t.replace("▁", " ")


def test_products_are_associative():
    rng = np.random.default_rng(1)
    a, b, c = (np.where(rng.random((n, k)) < 0.4, -np.inf, rng.integers(0, 9, (n, k)).astype(float)) for n, k in ((3, 4), (4, 5), (5, 2)))
    assert (sentence_pieces.times(sentence_pieces.times(a, b), c) == sentence_pieces.times(a, sentence_pieces.times(b, c))).all()


def test_scan_goes_through_a_tree():
    rng = np.random.default_rng(6)
    for n in (1, 2, 3, 7, 16, 21):
        sizes = rng.integers(1, 5, n + 1)
        states = [(None, None, np.where(rng.random((a, z)) < 0.3, -9.0, rng.integers(0, 9, (a, z)).astype(float))) for a, z in zip(sizes, sizes[1:])]
        path = sentence_pieces._scan(states)
        assert all(a[1] == b[0] for a, b in zip(path, path[1:]))
        whole = states[0][2]
        for _, _, matrix in states[1:]:  # the best path's weight, product by product
            whole = sentence_pieces.times(whole, matrix)
        assert sum(m[i, j] for (_, _, m), (i, j) in zip(states, path, strict=True)) == whole.max()


def test_sentence_pieces(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "SHARE", 2)
    m = sentence_pieces.load(sentence_pieces.default_path())
    giant = [r for r in rows if r.text and len(r.text) >= 1000][0]
    d = docs.select("doc_id", "text", F.lit(0).alias("chunk"), F.lit("x").alias("row")).unionByName(spark.createDataFrame([(5000 + i, giant.text, 1, "y") for i in range(9)], "doc_id long, text string, chunk int, row string"))
    encoded = sentence_pieces.encode_ids(spark, d, chunk=1000)
    whole = defaultdict(list)
    for r in sorted(encoded.collect(), key=lambda r: r.chunk):
        whole[r.row, r.doc_id].extend(r.ids)
    want = Counter((r.doc_id, tuple(m.encode(r.text))) for r in d.collect())
    assert Counter((d, tuple(ids)) for (_, d), ids in whole.items()) == want
    back = sentence_pieces.decode_ids(encoded).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((r.doc_id, (r.text or "").replace("▁", " ")) for r in d.collect())
    assert sentence_pieces.encode_ids(spark, empty(spark)).count() == 0


def test_sentence_pieces_query(spark, docs, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "CHUNK", 1000)
    m = sentence_pieces.load(sentence_pieces.default_path())
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = Counter()
    for r in rows:
        h = 0
        for i in m.encode(r.text):
            h = (h * sentence_pieces.BASE + i + 1) % sentence_pieces.PRIME
        want[r.doc_id, len(m.encode(r.text)), h, len((r.text or "").replace("▁", " ").encode())] += 1
    got = sentence_pieces.op7_sentence_pieces(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.n_pieces, r.ids_hash, r.decoded_bytes) for r in got) == want


def test_feistel():
    for n in (1, 2, 3, 100, 4097):
        assert sorted(training_order.feistel(np.arange(n), n, 9).tolist()) == list(range(n))
    assert (training_order.feistel(np.arange(999), 999, 1) != training_order.feistel(np.arange(999), 999, 2)).any()


def shards(folder):
    return {f: zlib.crc32(open(f"{folder}/{f}", "rb").read()) for f in sorted(os.listdir(folder)) if f.startswith("shard")}


def test_training_order(spark, docs, rows, library, tmp_path):
    source, at = str(tmp_path / "documents.parquet"), str(tmp_path / "out")
    docs.repartition(3).write.parquet(source)
    d = spark.read.parquet(source)
    index = sorted(training_order.write_shards(spark, d, at, length=64, shard_bytes=20_000).collect(), key=lambda r: r.slot)
    n = len(index)
    assert [r.slot for r in index] == list(range(n)) and len({r.shard for r in index}) > 2
    # The slot is the keyed permutation of the sequence's number in the stream.
    assert training_order.feistel(np.array([r.sequence for r in index]), n, 0).tolist() == list(range(n))
    k = training_order.shard_records(64, 20_000)
    assert all((r.shard, r.byte_offset) == (r.slot // k, r.slot % k * (4 + 2 * 64)) for r in index)
    stored = list(training_order.read_from(at, length=64, shard_bytes=20_000))
    assert [(zlib.crc32(s.tobytes()), len(s)) for s in stored] == [(r.ids_crc32, r.n_tokens) for r in index]
    for slot in (1, 70, k, 3 * k - 1, n - 1, n, n + 99):  # without an index
        part = list(training_order.read_from(at, slot, 64, 20_000))
        assert len(part) == max(0, n - slot) and all((a == b).all() for a, b in zip(part, stored[slot:]))
    # All but the last sequence are full, and the stream is the files' rows in order.
    by_sequence = [s for _, s in sorted(zip((r.sequence for r in index), stored, strict=True), key=lambda x: x[0])]
    assert all(len(s) == 64 for s in by_sequence[:-1])
    want = []
    for f in sorted(f for f in os.listdir(source) if f.endswith(".parquet")):
        for r in spark.read.parquet(f"{source}/{f}").coalesce(1).collect():
            want += [*library.encode(r.text or "", add_special_tokens=False).ids, training_order.END_ID]
    assert np.concatenate(by_sequence).tolist() == want
    assert training_order.write_shards(spark, empty(spark), str(tmp_path / "none")).count() == 0


def test_training_order_does_not_depend_on_partitions(spark, docs, tmp_path):
    source = str(tmp_path / "documents.parquet")
    docs.coalesce(1).sortWithinPartitions("doc_id").write.option("parquet.block.size", 20_000).option("parquet.page.size", 1024).option("parquet.block.size.row.check.min", 1).parquet(source)
    found = []
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("1g", "30k", "4k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        d = spark.read.parquet(source)
        found.append((d.rdd.getNumPartitions(), training_order.write_shards(spark, d, str(tmp_path / size), length=50, shard_bytes=9_000).count(), shards(tmp_path / size)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len({n for n, *_ in found}) == 3 and found[0][1:] == found[1][1:] == found[2][1:] and len(found[0][2]) > 3
    # Tables of another origin are ordered by columns first.
    found = []
    for parts in (1, 3, 17):
        at = str(tmp_path / f"p{parts}")
        training_order.write_shards(spark, docs.repartition(parts), at, length=50, shard_bytes=9_000, order_by=("doc_id", "text"))
        found.append(shards(at))
    assert found[0] == found[1] == found[2]


def test_training_order_wide_ids_and_columns_that_clash(spark, tmp_path):
    d = spark.createDataFrame([("a b c", 1, 2), (None, 3, 4)], "text string, slot int, sequence int")
    at = str(tmp_path / "out")
    assert training_order.write_shards(spark, d, at, length=3, wide=True, key=5).count() == 2
    assert sorted(map(len, training_order.read_from(at, length=3, wide=True))) == [2, 3]
