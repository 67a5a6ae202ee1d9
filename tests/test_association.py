"""The two-pass association and its neighbours against plain formulations."""

import itertools
import math
import random

import numpy as np

from sightline.functions import plates
from sightline.streaming import association as a


def test_assignment_is_the_best_of_all():
    rng = random.Random(5)
    for _ in range(150):
        options = {}
        for left in range(rng.randint(0, 4)):
            own = [(r, rng.choice([0.25, 0.5, 0.75, 1.0])) for r in range(4) if rng.random() < 0.6]
            if own:
                options[left] = own
        every = []
        for picks in itertools.product(*[[None, *own] for own in options.values()]):
            pairs = tuple((left, p[0]) for left, p in zip(options, picks, strict=True) if p)
            if len({r for _, r in pairs}) == len(pairs):
                every.append((sum(p[1] for p in picks if p), pairs))
        most = max(s for s, _ in every)
        first = min((p for s, p in every if s > most - 1e-9), key=lambda p: (not p, p))
        assert tuple(a.best_assignment(options)) == first
    many = {k: [(r, 1.0 / (1 + abs(k - r))) for r in range(20)] for k in range(20)}
    assert a.best_assignment(many) == [(k, k) for k in range(20)]  # beyond the limits: best first


def test_filter_is_the_matrix_form():
    rng = np.random.default_rng(2)
    f = a.BoxKalman((10, 10, 50, 30))
    x = np.array([30.0, 20.0, 40.0, 20.0, 0, 0, 0, 0])
    p = np.diag(a.START)
    h = np.eye(4, 8)
    for _ in range(12):
        t, corner = float(rng.uniform(0.0, 2.0)), rng.uniform(0, 40, 2)
        box = (*corner, *(corner + rng.uniform(5, 60, 2)))
        step = min(1.5, max(0.01, t))
        move = np.eye(8) + step * np.eye(8, k=4)
        x, p = move @ x, move @ p @ move.T + step * np.diag(a.DRIFT)
        got = f.predict(t)
        assert np.allclose(got, [x[0] - x[2] / 2, x[1] - x[3] / 2, x[0] + x[2] / 2, x[1] + x[3] / 2]) or x[2] < 2 or x[3] < 2
        gain = p @ h.T @ np.linalg.inv(h @ p @ h.T + np.diag(a.NOISE))
        seen = np.array([(box[0] + box[2]) / 2, (box[1] + box[3]) / 2, max(2.0, box[2] - box[0]), max(2.0, box[3] - box[1])])
        x, p = x + gain @ (seen - h @ x), (np.eye(8) - gain @ h) @ p
        f.update(box)
        assert np.allclose(f.x.ravel(), x)


def detection(x, confidence=0.9, identity="", y=0.0):
    return a.Detection((x, y, x + 60, y + 20), confidence, identity)


def test_two_passes():
    t = a.TwoPass()
    assert t.observe(0.0, [detection(0), detection(300)]) == [1, 2]
    assert t.observe(0.2, [detection(304), detection(5)]) == [2, 1]
    # A weak box near a track takes it only after the sure ones have chosen.
    assert t.observe(0.4, [detection(8, 0.2), detection(10, 0.9), detection(306, 0.3)]) == [3, 1, 2]
    assert t.observe(0.4, [detection(0)]) == []  # not newer
    assert t.observe(20.0, [detection(10)]) == [4]  # all have aged out
    assert len(t.tracks) == 1


def test_a_contradicting_plate_does_not_take_the_track():
    t = a.TwoPass()
    for k in range(3):
        assert t.observe(0.1 * k, [detection(2 * k, identity="12ب34567")]) == [1]
    assert t.observe(0.3, [detection(6, identity="12ب34568")]) == [1]  # one character in a box that goes on
    assert t.observe(0.4, [detection(8, identity="98س76511")]) == [2]
    t.tracks[1].misses = 2
    assert t.conflict(t.tracks[1], detection(8, identity="12ب34568"))


def test_static_regions():
    s = a.StaticRegions()
    still, moving = ("a", 0.005, False), ("a", 0.02, False)
    assert s.observe(0, [still]) == [False] and s.observe(1, [moving]) == [True]  # two hits are taken back
    assert s.observe(2, [still]) == [False] and s.observe(3, [still]) == [False]  # kept back from now on
    assert s.observe(4, [moving]) == [False] and s.observe(5, [("a", 0.03, False)]) == [True]
    assert s.observe(6, [("a", 0.0, True)]) == [True]  # a strong reading always shows
    assert s.observe(28.5, [moving]) == [True]  # the time is over


def test_assisted_rows():
    primary = [((0, 0, 10, 10), True), ((100, 0, 110, 10), False)]
    shadow = [(1, 0, 11, 10), (101, 0, 111, 10), (50, 0, 60, 10), (51, 0, 61, 10)]
    assert a.assisted(primary, shadow) == [("primary", 0), ("shadow", 1), ("shadow", 3)]


def test_template_alignment_is_every_choice():
    letters = plates.LETTERS + plates.LATIN_LETTERS
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice("0123456789OIBZSبس") for _ in range(rng.randint(6, 12)))
        want: dict[str, float] = {}
        for picks in itertools.combinations(range(len(text)), 8):
            out, penalty = "", 0.16 * (len(text) - 8)
            for place, i in enumerate(picks):
                c = text[i]
                if place == 2:
                    out += c if c in letters else "!"
                elif c.isdigit():
                    out += c
                else:
                    out, penalty = out + a.DIGIT_CONFUSIONS.get(c, "!"), penalty + 0.20
            if "!" not in out and len(text) - 8 <= 3:
                want[out] = min(want.get(out, math.inf), penalty)
        got = a.template_alignments(text, letters, beam=10**9, most=10**9) if len(text) >= 7 else []
        assert {k: round(v, 9) for k, v in got} == {k: round(v, 9) for k, v in want.items()}
        assert a.template_alignments(text, letters) == got[:12] or len(got) > 12
