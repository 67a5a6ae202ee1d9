"""Queries without SQL against plain Python over the same rows."""

import difflib
import os
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sightline.operators import fusion, joins, matching
from sightline.plans import views as v
from sightline.plans.catalog import QUERIES
from sightline.streaming import association, kernels

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def pairs(spark):
    out = defaultdict(list)
    for r in joins.eligible(joins.expected_events(spark, SF), joins.predicted_events(spark, SF), ["sample"]).select("sample", "e.e", "p.p", "e.start_ms", "e.end_ms", "p.ts_ms").collect():
        middle = None if r.start_ms is None else (r.start_ms + r.end_ms) / 2
        out[r.sample].append((r.e, r.p, abs(r.ts_ms - middle) if middle is not None else 0.0))
    return out


def most(edges):
    """The size of a maximum matching, by subsets of rights."""
    best = {0: 0}
    rights = {p: 1 << k for k, p in enumerate(sorted({p for _, p, _ in edges}))}
    for e in sorted({e for e, _, _ in edges}):
        grown = dict(best)
        for used, n in best.items():
            for bit in {rights[p] for x, p, _ in edges if x == e}:
                if not used & bit:
                    grown[used | bit] = max(grown.get(used | bit, 0), n + 1)
        best = grown
    return max(best.values())


def test_event_matching(spark, pairs):
    got = defaultdict(list)
    for r in QUERIES["event_matching"](spark, SF).collect():
        got[r["sample"]].append((r.e, r.p))
    assert set(got) == set(pairs)
    for sample, edges in pairs.items():
        own = got[sample]
        assert len({e for e, _ in own}) == len({p for _, p in own}) == len(own)
        assert set(own) <= {(e, p) for e, p, _ in edges}
        if len({p for _, p, _ in edges}) <= 12:
            assert len(own) == most(edges)


def test_least_cost_assignment(spark, pairs):
    got = defaultdict(dict)
    for r in QUERIES["least_cost_assignment"](spark, SF).collect():
        got[r["sample"]][r.e] = r.p
    for sample, edges in pairs.items():
        cost = {(e, p): c / 20 for e, p, c in edges}
        es, ps = sorted({e for e, _, _ in edges}), sorted({p for _, p, _ in edges})
        if len(ps) > 10:
            continue
        best = {0: 0.0}
        for e in es:
            grown = {u: c + 1.0 for u, c in best.items()}
            for u, c in best.items():
                for k, p in enumerate(ps):
                    if (e, p) in cost and not u >> k & 1:
                        grown[u | 1 << k] = min(grown.get(u | 1 << k, 1e9), c + cost[e, p])
            best = grown
        mine = sum(cost[e, p] for e, p in got[sample].items()) + len(es) - len(got[sample])
        assert abs(mine - min(best.values())) < 1e-9


def frames(spark):
    out = defaultdict(list)
    for r in matching._detections(spark, SF).orderBy("id").collect():
        out[r.camera_id].append(r)
    return out


def test_tracks(spark):
    got = {r.id: r.track for r in QUERIES["tracks"](spark, SF).collect()}
    for rows in frames(spark).values():
        tracker, by = kernels.Tracker(), defaultdict(list)
        for r in rows:
            by[r.seq].append(r)
        for seq in sorted(by):
            ids = tracker.update(seq, [(r.x1, r.y1, r.x2, r.y2) for r in by[seq]])
            assert [got[r.id] for r in by[seq]] == ids


def test_non_maximum_suppression(spark):
    by = defaultdict(list)
    for r in matching._detections(spark, SF).collect():
        by[r.seq].append(r)
    want = set()
    for rows in by.values():
        kept = []
        for r in sorted(rows, key=lambda r: (-r.score, r.id)):
            if all(kernels.iou((r.x1, r.y1, r.x2, r.y2), (o.x1, o.y1, o.x2, o.y2)) <= 0.38 for o in kept):
                kept.append(r)
        want |= {r.id for r in kept}
    assert {r.id for r in QUERIES["non_maximum_suppression"](spark, SF).collect()} == want and want


def test_diverse_frames(spark):
    got = defaultdict(set)
    for r in QUERIES["diverse_frames"](spark, SF).collect():
        got[r.camera_id].add(r.seq)
    for camera, rows in frames(spark).items():
        held = []
        for r in sorted(rows, key=lambda r: (r.id, r.score)):
            near = [x for x in held if abs(x[1] - r.id) <= 100]
            if not any(x[0] >= r.score for x in near):
                held = sorted([x for x in held if x not in near] + [(r.score, r.id)])[-5:]
        assert got[camera] == {i for _, i in held}


def test_plate_similarity(spark):
    rows = v.feedback(spark, SF).collect()
    got = {r.id: r.ratio for r in QUERIES["plate_similarity"](spark, SF).collect()}
    assert all(abs(got[r.id] - difflib.SequenceMatcher(None, r.observed_norm, r.corrected_norm).ratio()) < 1e-12 for r in rows) and rows


def test_fused_tracks_and_calibration(spark):
    by = defaultdict(list)
    for r in fusion._obs(spark, SF).collect():
        by[r.track_id].append(r)
    decided = {}
    for settings in [{}, {"gap_seconds": 1.5, "min_confidence": 0.70, "min_margin": 0.1, "min_support": 1}]:
        for track, rows in by.items():
            e = kernels.Evidence(fusion.LAYOUT, **settings)
            for r in sorted(rows, key=lambda r: (r.ts, r.text, r.confidence, r.quality)):
                e.add(r.ts, r.text, r.confidence, r.quality)
            decided[track, len(settings)] = e.decide()
    got = {r.track_id: (r.text, r.confidence, r.phase) for r in QUERIES["fused_tracks"](spark, SF).collect()}
    assert got == {t: x for (t, n), x in decided.items() if n == 0}
    # The calibration's figures, recounted for the configuration that it chose.
    chosen = QUERIES["calibration"](spark, SF).collect()[0]
    settings = joins.grid(fusion.GRID)[chosen.ordinal]
    hit = readable = taken = n = 0
    for r in v.table(spark, SF, "orders").collect():
        k = r.o_orderkey
        if k not in by or k % 4:
            continue
        e = kernels.Evidence(fusion.LAYOUT, **settings)
        for x in sorted(by[k], key=lambda r: (r.ts, r.text, r.confidence, r.quality)):
            e.add(x.ts, x.text, x.confidence, x.quality)
        text, _, phase = e.decide()
        right = "" if k % 10 == 0 else spark.range(1).select(v.plate_of(F.lit(k % 100))).collect()[0][0] if False else plate(k % 100) if k % 10 else ""
        said = text if phase == "locked" else ""
        n, readable, taken, hit = n + 1, readable + (right != ""), taken + (said != ""), hit + (right != "" and said == right)
    assert abs(chosen.accuracy - hit / max(1, readable)) < 1e-12 and abs(chosen.precision - hit / max(1, taken)) < 1e-12


def test_replay_counts_tracks_of_every_configuration(spark):
    """Batches of few rows, so that tracks span them; rows without a track or a time."""
    order = lambda r: (r[1] is not None, r[1] or 0.0, *r[2:])
    readings = [(n % 90 if n % 17 else None, None if n % 23 == 0 else float(n * 7 % 11) / 2, plate(n % 90 + (n % 5 == 0)) if n % 13 else "x1", 0.5 + n * 37 % 50 / 100, 0.6 + n % 7 / 20) for n in range(600)]
    readings += [(91, float(n), plate(91), 0.9, 0.9) for n in range(40)]
    expected = [(n, "holdout" if n % 4 == 0 else "train", "" if n % 10 == 0 else None if n % 19 == 0 else plate(n)) for n in range(2, 99)] + [(7, "train", plate(8))]
    parameters = {"gap_seconds": [0.08, 1.5], "min_confidence": [0.55, 0.70, 0.85], "min_margin": [0.1, 0.3], "min_support": [1, 2, 3]}
    by, want = defaultdict(list), defaultdict(Counter)
    for r in readings:
        by[r[0]].append(r)
    for k, c in enumerate(joins.grid(parameters)):
        for track, split, right in expected:
            if track in by:
                e = kernels.Evidence(fusion.LAYOUT, **c)
                for r in sorted(by[track], key=order):
                    e.add(*r[1:])
                text, _, phase = e.decide()
                said = text if phase == "locked" else ""
                want[k, split].update(tracks=1, readable=bool(right), taken=said != "", hit=bool(right) and said == right, false=right == "" and said != "")
    o = spark.createDataFrame(readings, "track_id long, ts double, text string, confidence double, quality double")
    x = spark.createDataFrame(expected, "track_id long, split string, expected string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = fusion.replay(o, x, parameters)
        got = {(r.ordinal, r.split): r for r in fusion.config_metrics(rows).collect()}
        twice = [t.unionByName(t.withColumn("track_id", F.col("track_id") + 1000)) for t in (o, x)]
        assert fusion.replay(*twice, parameters).count() == rows.count()  # counts, not a row a track and configuration
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == set(want)
    for key, n in want.items():
        figures = (n["tracks"], n["hit"] / max(1, n["readable"]), n["taken"] / n["tracks"], n["hit"] / max(1, n["taken"]), n["false"])
        assert (got[key].tracks, got[key].accuracy, got[key].coverage, got[key].precision, got[key].false_accepts) == figures
    assert len({n["hit"] for n in want.values()}) > 3


def test_calibration_replays_once(spark, capsys):
    QUERIES["calibration"](spark, SF).explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1


def plate(k):
    from sightline.functions.plates import LETTERS

    return f"{10 + k % 90}{LETTERS[k % 24]}{100 + k * 37 % 900}{10 + k * 7 % 90}"


def test_event_accuracy(spark):
    got = {r.category: r for r in QUERIES["event_accuracy"](spark, SF).collect()}
    e, p = joins.expected_events(spark, SF).collect(), joins.predicted_events(spark, SF).collect()
    pairs = defaultdict(list)
    for r in joins.eligible(joins.expected_events(spark, SF), joins.predicted_events(spark, SF), ["sample"]).select("sample", "e.e", "p.p").collect():
        pairs[r["sample"]].append((r.e, r.p, 0.0))
    n_expected, n_predicted = Counter(r["sample"] for r in e), Counter(r["sample"] for r in p)
    for category in got:
        samples = {s for s in n_expected if s % 8 == category}
        matched = sum(most(pairs[s]) if pairs[s] else 0 for s in samples)
        assert (got[category].matched, got[category].missed) == (matched, sum(n_expected[s] for s in samples) - matched)
        complete = all(s % 3 for s in samples)
        assert got[category].false_positives == (sum(n_predicted[s] for s in samples) - matched if complete else None)


def test_engines_agree(spark):
    by, want = defaultdict(list), Counter()
    for r in v.sightings(spark, SF).collect():
        by[r.camera_id].append((r.t, f"e{r.id % 2}", str(r.k % 3)))
    for camera, rows in by.items():
        waiting = []
        for t, engine, text in sorted(rows):
            want.update((camera, x[0], f"only-{x[1]}") for x in waiting if t - x[0] > 7200)
            waiting = [x for x in waiting if t - x[0] <= 7200]
            others = sorted((abs(t - x[0]), x[0], x[2], x) for x in waiting if x[1] != engine)
            if others:
                waiting.remove(others[0][3])
                want[camera, t, "agree" if others[0][2] == text else "disagree"] += 1
            elif (engine, text) not in {x[1:] for x in waiting}:
                waiting.append((t, engine, text))
        want.update((camera, x[0], f"only-{x[1]}") for x in waiting)
    assert Counter((r.camera_id, r.ts, r.verdict) for r in QUERIES["engines_agree"](spark, SF).collect()) == want


def test_assisted_rows(spark):
    li = v.table(spark, SF, "lineitem").collect()
    by = defaultdict(list)
    for r in li:
        x, y = float(r.l_partkey % 50), float(r.l_suppkey % 10)
        by[r.l_orderkey].append((r.l_linenumber * 1_000_000 + r.l_partkey, r.l_linenumber % 2 == 0, (x, y, x + 20, y + 10), r.l_partkey % 3 == 0))
    want = Counter()
    for frame, rows in by.items():
        p, s = ([r for r in sorted(rows) if r[1] == first] for first in (True, False))
        want.update((frame, e, (p if e == "primary" else s)[k][0]) for e, k in association.assisted([(r[2], r[3]) for r in p], [r[2] for r in s]))
    assert Counter((r.frame, r.engine, r.id) for r in QUERIES["merge_assisted"](spark, SF).collect()) == want


def by_time(rows):
    """Rows of one camera, a list for each time, in order."""
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["ts"], r["id"])):
        out[r["ts"]].append(r)
    return [out[t] for t in sorted(out)]


def test_two_pass_tracks(spark):
    got, by = {r.id: r.track for r in QUERIES["two_pass_tracks"](spark, SF).collect()}, defaultdict(list)
    for r in v.sightings(spark, SF).collect():
        x, y = float(r.id // 30 % 40 * 12 + r.id % 3 * 200), r.k / 10
        by[r.camera_id].append({"ts": r.id // 30 * 0.2, "id": r.id, "d": association.Detection((x, y, x + 60, y + 20), r.confidence, r.plate if r.id % 2 == 0 else "")})
    for rows in by.values():
        tracker = association.TwoPass()
        for frame in by_time(rows):
            assert [got[r["id"]] for r in frame] == tracker.observe(frame[0]["ts"], [r["d"] for r in frame])
    assert len(got) == 1000


def test_static_regions(spark):
    got, by = {r.id: r.shown for r in QUERIES["static_regions"](spark, SF).collect()}, defaultdict(list)
    for r in v.sightings(spark, SF).collect():
        by[r.camera_id].append({"ts": float(r.id // 20), "id": r.id, "r": (f"r{r.k % 3}", r.id % 40 / 1000, r.id % 17 == 0)})
    for rows in by.values():
        regions = association.StaticRegions()
        for frame in by_time(rows):
            assert [got[r["id"]] for r in frame] == regions.observe(frame[0]["ts"], [r["r"] for r in frame])
    assert set(got.values()) == {True, False}


def test_tracked_visits(spark):
    got, by = {r.id: r.visit for r in QUERIES["tracked_visits"](spark, SF).collect()}, defaultdict(list)
    for r in v.sightings(spark, SF).collect():
        i, true = r.id, plate((r.camera_id + r.id // 200) % 100)
        seen = kernels.Sighting(i // 60, "" if i % 7 == 0 else true[:7] + "0" if i % 5 == 0 else true, i % 3 == 0, (i % 40, 0.0, i % 40 + 60, 20.0))
        by[r.camera_id].append({"ts": float(i // 2), "id": i, "s": seen if i % 11 else None})
    for rows in by.values():
        ledger = kernels.TrackedVisits(absence_seconds=200.0, cooldown=100.0)
        for frame in by_time(rows):
            found = iter(ledger.watch(frame[0]["ts"], [r["s"] for r in frame if r["s"]]))
            assert [got[r["id"]] for r in frame] == [next(found) if r["s"] else None for r in frame]
    assert len({v for v in got.values() if v}) > 1


def test_latest_queue(spark):
    by = defaultdict(list)
    for r in v.sightings(spark, SF).orderBy("id").collect():
        by[r.camera_id].append((r.id, r.t, f"k{r.k % 9}", float(r.id % 5)))
    got = {r.id: (r.said, r.taken) for r in QUERIES["latest_queue"](spark, SF).collect()}
    for rows in by.values():
        waiting, served = [], Counter()  # (key, id, t, priority), one a key
        for n, (i, t, key, priority) in enumerate(rows, 1):
            said = "replaced" if key in [w[0] for w in waiting] else "added"
            waiting = [w for w in waiting if w[0] != key] + [(key, i, t, priority)]
            if len(waiting) > 4:
                worst = sorted(waiting, key=lambda w: (w[3], -w[2], w[0]))[-1]
                waiting.remove(worst)
                said = "rejected" if worst[0] == key else "evicted"
            taken = None
            if n % 3 == 0:
                waiting = [w for w in waiting if t - w[2] <= 200_000.0]
                if waiting:
                    least = min(served[w[0]] for w in waiting)
                    best = min(waiting, key=lambda w: (w[3] + 8.0 * (served[w[0]] - least), w[2], w[0]))
                    waiting.remove(best)
                    served[best[0]] += 1
                    taken = best[1]
            assert got[i] == (said, taken)
    assert {"added", "replaced", "evicted"} <= {s for s, _ in got.values()}


def test_ctc_readings(spark):
    import itertools

    alphabet, slots = "12a", ["12", "a", "12"]
    got = {r.id: r for r in QUERIES["ctc_readings"](spark, SF).where("id < 40").collect()}
    for r in matching._steps(spark, SF).where("id < 40").collect():
        total = Counter()
        for path in itertools.product(range(4), repeat=6):
            p = 1.0
            for step, c in zip(r.steps, path, strict=True):
                p *= step[c]
            text = "".join(alphabet[c - 1] for c, _ in itertools.groupby(path) if c)
            if len(text) == 3 and all(x in s for x, s in zip(text, slots, strict=True)):
                total[text] += p
        best = max(total.items(), key=lambda x: x[1])
        assert abs(got[r.id].p - total[got[r.id].best]) < 1e-9 and abs(got[r.id].p - best[1]) < 1e-9
        greedy = [max(range(4), key=lambda c: (s[c], -c)) for s in r.steps]
        assert got[r.id].greedy == "".join(alphabet[c - 1] for c, _ in itertools.groupby(greedy) if c)


def test_normaliser_runs_once_a_row(spark):
    plan = QUERIES["temporal_vote"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") <= 6 and plan.count("regexp_replace(") <= 6
