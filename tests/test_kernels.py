import itertools
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sightline.operators.curation import group_split
from sightline.streaming import kernels as k


def test_matching_moves_others_away():
    assert len(k.max_matching([[0, 1], [0], [1, 2]])) == 3
    assert k.max_matching([[0], [0]]) == {0: 0}


def test_matching_follows_long_chains():
    n = 3000
    options = [[0], *[[i - 1, i] for i in range(1, n)]]  # each new one moves all before it
    assert len(k.max_matching([[i, i + 1] if i + 1 < n else [i] for i in range(n)] + [[0]])) == n
    assert len(k.max_matching(options)) == n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), unique=True, max_size=4), max_size=5))
def test_matching_is_maximal(options):
    best = 0
    for picks in itertools.product(*[[None, *o] for o in options]):
        used = [p for p in picks if p is not None]
        best = max(best, len(used)) if len(set(used)) == len(used) else best
    assert len(k.max_matching(options)) == best


def test_assignment_is_cheapest():
    rng = random.Random(3)
    for _ in range(80):
        n, m = rng.randint(1, 4), rng.randint(1, 4)
        cost = [[rng.choice([float("inf"), rng.randint(0, 9)]) for _ in range(m)] for _ in range(n)]
        best = min(
            sum(4.0 if p is None else cost[i][p] for i, p in enumerate(picks))
            for picks in itertools.product([None, *range(m)], repeat=n)
            if len([p for p in picks if p is not None]) == len({p for p in picks if p is not None})
        )
        pairs = k.min_cost_pairs(cost, 4.0)
        assert len({j for _, j in pairs}) == len(pairs)
        assert sum(cost[i][j] for i, j in pairs) + 4.0 * (n - len(pairs)) == best


def test_suppression_and_diversity():
    assert k.suppress([(0, 0, 10, 10), (1, 0, 11, 10), (20, 0, 30, 10)], [0.5, 0.9, 0.1], 0.38) == [1, 2]
    assert k.diverse([(1, 0.5), (2, 0.9), (3, 0.8), (9, 0.1)]) == [2, 9]


def test_tracker():
    t = k.Tracker(max_missed=1)
    first = t.update(1, [(0, 0, 10, 10), (50, 0, 60, 10)])
    assert t.update(2, [(52, 0, 62, 10), (2, 0, 12, 10)]) == first[::-1]
    assert t.update(2, [(0, 0, 1, 1)]) == []
    t.update(3, [])
    t.update(4, [])
    assert t.update(5, [(2, 0, 12, 10)]) == [3]


def test_tracker_expects_four_steps_at_most():
    t = k.Tracker()
    t.update(1, [(0, 0, 10, 10)])
    t.update(2, [(8, 0, 18, 10)])  # smoothed to 6, velocity 3
    assert t.tracks[1]["box"] == (6, 0, 16, 10) and t.tracks[1]["velocity"][0] == 3
    assert t.expected(t.tracks[1], 3)[0] == 9 and t.expected(t.tracks[1], 6)[0] == t.expected(t.tracks[1], 500)[0] == 18
    assert t.update(500, [(18, 0, 28, 10)]) == [1]  # a gap does not carry the track away
    shrinking = {"box": (0, 0, 10, 10), "seq": 1, "velocity": (4.0, 0.0, -4.0, 0.0)}
    assert t.expected(shrinking, 4) == (0, 0, 10, 10)  # no box is left, so it stays


def test_tracker_rounds_and_keeps_boxes():
    t = k.Tracker(smoothing=0.5)
    t.update(1, [(0.0, 0.0, 9.0, 9.0)])
    t.update(2, [(1.0, 0.0, 12.0, 9.0)])
    assert all(float(v).is_integer() for v in t.tracks[1]["box"])


def test_visits():
    v = k.Visits(cooldown=10)
    assert v.observe(0, ["a"]) == [1] and v.observe(0.2, ["a"]) == [1]
    for ts in (0.4, 0.8, 1.4):
        v.observe(ts, [])
    assert v.observe(5, ["a"]) == [1]  # within the cooldown
    for ts in (6, 7, 8, 20):
        v.observe(ts, [])
    assert v.observe(21, ["a"]) == [2]


def reading(track, plate, strict=False, x=0.0):
    return k.Sighting(track, plate, strict, (x, 0.0, x + 60, 20.0))


def test_a_visit_may_be_named_anew():
    v = k.TrackedVisits()
    assert v.watch(0, [reading(1, "12b34568")]) == [1]
    assert v.watch(0.2, [reading(1, "12b34567")]) == [1] and list(v.open) == ["12b34568"]  # one place, not strict
    assert v.watch(0.4, [reading(1, "12b34567", True)]) == [1] and list(v.open) == ["12b34567"]
    assert v.watch(0.6, [reading(1, "")]) == [1]
    assert v.watch(0.8, [reading(1, "99c11122", True)]) == [2]  # the visit was named strictly


def test_a_strict_reading_corrects_its_own_track():
    v = k.TrackedVisits()
    assert v.watch(0, [reading(1, "77x00011")]) == [1]
    assert v.watch(0.2, [reading(1, "12b34567", True)]) == [1]
    assert v.watch(0.4, [reading(2, "12b34567")]) == [1]


def test_a_visit_goes_on_in_another_track():
    v = k.TrackedVisits()
    assert v.watch(0, [reading(1, "12b34568", x=10)]) == [1]
    assert v.watch(0.5, [reading(2, "12b34567", True, x=20)]) == [1]
    v = k.TrackedVisits()
    v.watch(0, [reading(1, "12b34568", x=10)])
    assert v.watch(0.5, [reading(2, "12b34567", True, x=900)]) == [2]  # elsewhere
    v = k.TrackedVisits()
    assert v.watch(0, [reading(1, "12b34568", x=10), reading(2, "12b34569", x=12)]) == [1, 2]  # another track's is strict, or another visit
    assert v.watch(0.5, [reading(3, "12b34567", True, x=20)]) == [3]  # two could go on
    v = k.TrackedVisits()
    assert v.watch(0, [reading(1, "12b34568", x=10), reading(2, "99c34569", x=12)]) == [1, 2]
    assert v.watch(0.1, [reading(3, "")]) == [None]  # two visits: whose it is is not known


def test_tracked_visits_end_like_others():
    v = k.TrackedVisits(cooldown=10)
    assert v.watch(0, [reading(1, "12b34567", True)]) == [1]
    for ts in (1, 2, 3):
        v.watch(ts, [])
    assert v.watch(5, [reading(2, "12b34567")]) == [1]
    for ts in (6, 7, 8, 20):
        v.watch(ts, [])
    assert v.open == {} and v.watch(21, [reading(3, "12b34567")]) == [2]


def test_suppressor_chains_and_late_rows():
    s = k.Suppressor()
    assert [s.decide("a", t) for t in (0, 15, 30)] == ["new", "same_camera_window", "same_camera_window"]
    assert s.decide("b", 31) == "overlapping_camera_window"
    assert s.decide("b", 5) == "new" and s.last == ("b", 31)


def test_queue():
    q = k.LatestQueue(capacity=2)
    assert q.put("a", 1, 5, 0) == "added" and q.put("a", 2, 5, 0) == "replaced" and q.put("b", 3, 1, 0) == "added"
    assert q.put("c", 4, 9, 0) == "rejected" and q.put("d", 5, 0, 0) == "evicted"
    assert q.take(0.5)[0] == "d" and q.take(5) is None


def test_decoding():
    rows = [[0.1, 0.8, 0.1], [0.1, 0.8, 0.1], [0.8, 0.1, 0.1], [0.1, 0.8, 0.1], [0.1, 0.1, 0.8]]
    assert k.ctc_greedy(rows, "ab") == "aab"
    best = k.ctc_beam(rows, "ab", ["a", "a", "b"])
    assert best[0][0] == "aab" and 0 < best[0][1] <= 1
    assert k.align_slots("1x2", ("12", "12", "12"))[1].count("") == 1


@given(st.sets(st.text("abcdef", min_size=1, max_size=3), min_size=2), st.floats(0.05, 0.5), st.integers(0, 99))
def test_group_split(groups, ratio, seed):
    held = group_split(list(groups), ratio, seed)
    assert held < groups and held and held == group_split(sorted(groups, reverse=True), ratio, seed)


def test_evidence_locks_on_independent_readings():
    layout = ["12", "ab", "12"]
    e = k.Evidence(layout)
    assert e.decide() == ("", 0.0, "empty")
    for ts in (0.0, 0.01, 0.02):  # one independent reading
        e.add(ts, "1a2", 0.9, 0.8)
    assert (e.independent, e.decide()[2]) == (1, "reading")
    e.add(0.2, "1a2", 0.9, 0.8)
    text, confidence, phase = e.decide()
    assert (text, phase) == ("1a2", "locked") and 0.9 < confidence <= 1
    for ts in (0.4, 0.6, 0.8):
        e.add(ts, "1b2", 0.9, 0.8)
    assert e.decide()[2] == "reading"  # the second place is split


def test_least_evidence_is_what_decide_compares():
    rng, layout, worth = random.Random(5), ["12", "abcd", "123"], [(0.08, 0.35), (1.5, 0.5)]
    tracks = []
    for _ in range(300):
        rows = [(rng.choice([-float("inf"), float(rng.randrange(5)), rng.random() * 4]), rng.choice(["1a2", "1a3", "2b2", "1c1", "d2", "1", "", "1a?2"]), rng.choice([0.0, rng.random(), 0.9]), rng.random()) for _ in range(rng.choice([1, 2, 5, 20]))]
        tracks.append(sorted(rows))
    flat = [r for t in tracks for r in t]
    texts = sorted({r[1] for r in flat})
    ts, which, confidence, quality = np.array([r[0] for r in flat]), np.array([texts.index(r[1]) for r in flat]), np.array([r[2] for r in flat]), np.array([r[3] for r in flat])
    starts = np.cumsum([0] + [len(t) for t in tracks[:-1]])
    locked = 0
    for (gap, correlated), (said, *least) in zip(worth, k.least_evidence(layout, starts, ts, texts, which, confidence, quality, worth), strict=True):
        for i, rows in enumerate(tracks):
            own = [float(x[i]) for x in least]
            higher = [[np.nextafter(x, 9e9) if n == m else x for m, x in enumerate(own)] for n in range(3)]
            for limits in ([0.5, 0.1, 1], [0.6, 0.2, 2], *([own, *higher] if own[0] == own[0] else [])):  # at what it reaches, and a bit above
                e = k.Evidence(layout, gap, correlated, *limits)
                for t, *r in rows:
                    e.add(None if t == -float("inf") else t, *r)
                text, _, phase = e.decide()
                assert (phase == "locked") == all(x >= y for x, y in zip(own, limits, strict=True))
                assert phase != "locked" or text == said[i]
                locked += phase == "locked"
    assert locked > 300


def test_agreement():
    a = k.Agreement(1.0)
    assert a.add(0.0, "x", "p") == [] and a.add(0.1, "x", "p") == []  # the same text waits once
    assert a.add(0.5, "y", "p") == [(0.5, "agree")]
    assert a.add(0.6, "x", "p") == [] and a.add(0.7, "y", "q") == [(0.7, "disagree")]
    a.add(1.0, "y", "r")
    assert a.add(3.0, "x", "r") == [(1.0, "only-y")] and a.flush() == [(3.0, "only-x")]
