"""Two-pass association of detections with tracks, and other kernels over a camera's
frames. Like the other kernels: plain data, no Spark."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np

from .kernels import Box, centre, iou

#: The filter's variances (centre, size, their speeds).
START, DRIFT, NOISE = [16.0, 16.0, 9.0, 9.0, 100.0, 100.0, 36.0, 36.0], [2.0, 2.0, 1.0, 1.0, 12.0, 12.0, 5.0, 5.0], [7.0, 7.0, 5.0, 5.0]
#: Detections of less confidence wait for the second pass.
HIGH = 0.45
#: Characters that a digit's place may be misread as.
DIGIT_CONFUSIONS = {"O": "0", "Q": "0", "D": "0", "I": "1", "L": "1", "|": "1", "Z": "2", "E": "3", "A": "4", "S": "5", "ه": "5", "ع": "6", "G": "6", "T": "7", "B": "8", "P": "9", "و": "9"}


class BoxKalman:
    """Constant velocity of a box's centre and size. Each of the four quantities has
    its own two-state filter, as nothing couples them."""

    def __init__(self, box: Box):
        self.x = np.array([self._measured(box), [0.0] * 4])
        self.p = np.zeros((2, 2, 4))
        self.p[0, 0], self.p[1, 1] = START[:4], START[4:]

    @staticmethod
    def _measured(box: Box) -> list[float]:
        return [*centre(box), max(2.0, box[2] - box[0]), max(2.0, box[3] - box[1])]

    def box(self) -> Box:
        cx, cy, w, h = self.x[0]
        w, h = max(2.0, w), max(2.0, h)
        return cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2

    def predict(self, elapsed: float) -> Box:
        t = min(1.5, max(0.01, elapsed))
        p = self.p
        self.x[0] += t * self.x[1]
        p[0, 0] += t * (p[0, 1] + p[1, 0]) + t * t * p[1, 1] + t * np.array(DRIFT[:4])
        p[0, 1] += t * p[1, 1]
        p[1, 0] = p[0, 1]
        p[1, 1] += t * np.array(DRIFT[4:])
        return self.box()

    def update(self, box: Box) -> Box:
        p = self.p
        gain = np.stack([p[0, 0], p[1, 0]]) / (p[0, 0] + np.array(NOISE))
        self.x += gain * (np.array(self._measured(box)) - self.x[0])
        self.p = p - gain[:, None] * p[0][None]
        return self.box()


def best_assignment(options: dict[int, list[tuple[int, float]]], most_left: int = 10, most_right: int = 12) -> list[tuple[int, int]]:
    """One-to-one pairs (left, right) of the largest total score, of equal ones the
    first in order: over sets of taken rights, left by left. Beyond the limits the best
    pairs are taken first."""
    rights = sorted({r for own in options.values() for r, _ in own})
    if len(options) > most_left or len(rights) > most_right:
        taken: dict[int, int] = {}
        for _, left, right in sorted(((s, a, b) for a, own in options.items() for b, s in own), reverse=True):
            if left not in taken and right not in taken.values():
                taken[left] = right
        return sorted(taken.items())
    bit = {r: 1 << k for k, r in enumerate(rights)}
    better = lambda a, b: a[0] > b[0] + 1e-9 or (abs(a[0] - b[0]) <= 1e-9 and (not b[1] or (a[1] and a[1] < b[1])))
    found: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
    for left, own in options.items():
        grown = dict(found)
        for used, (score, pairs) in found.items():
            for right, s in own:
                if not used & bit[right]:
                    now = (score + s, (*pairs, (left, right)))
                    if used | bit[right] not in grown or better(now, grown[used | bit[right]]):
                        grown[used | bit[right]] = now
        found = grown
    best = (0.0, ())
    for each in found.values():
        best = each if better(each, best) else best
    return list(best[1])


@dataclass
class Detection:
    box: Box
    confidence: float
    identity: str = ""  # the plate, where it is read surely


@dataclass
class _Track:
    box: Box
    seen: float
    kalman: BoxKalman
    predicted_at: float
    predicted: Box | None = None
    centres: list[tuple[float, float]] = field(default_factory=list)
    misses: int = 0
    plates: Counter = field(default_factory=Counter)
    emitted: str = ""


@dataclass
class TwoPass:
    """Tracks of one camera: surely detected boxes choose first, the others among the
    tracks left over; a track whose plate contradicts a box does not take it."""

    max_age: float = 2.4
    tracks: dict[int, _Track] = field(default_factory=dict)
    next_id: int = 1
    last: float = -math.inf

    @staticmethod
    def score(t: _Track, box: Box) -> tuple[float, float, float, float, float]:
        """Total, overlap, proximity, ratio of areas, agreement of direction."""
        expected, along = t.predicted or t.box, 0.5
        if len(t.centres) >= 2:
            (ax, ay), (bx, by) = t.centres[-2:]
            vx, vy = bx - ax, by - ay
            speed = math.hypot(vx, vy)
            if speed >= 2.0:
                w, h = (max(2.0, expected[2] - expected[0]), max(2.0, expected[3] - expected[1]))
                expected = (bx + vx - w / 2, by + vy - h / 2, bx + vx + w / 2, by + vy + h / 2)
            cx, cy = centre(box)
            far = math.hypot(cx - bx, cy - by)
            if speed >= 1.0 and far >= 1.0:
                along = min(1.0, max(0.0, ((vx * (cx - bx) + vy * (cy - by)) / (speed * far) + 1) / 2))
        sides = [max(2.0, b[k + 2] - b[k]) for b in (expected, box) for k in (0, 1)]
        (px, py), (dx, dy) = centre(expected), centre(box)
        near = max(0.0, 1 - math.hypot(px - dx, py - dy) / (max(sides) * 1.6))
        areas = sides[0] * sides[1], sides[2] * sides[3]
        size = min(areas) / max(areas)
        overlap = iou(expected, box)
        return 0.55 * overlap + 0.20 * near + 0.10 * size + 0.15 * along, overlap, near, size, along

    @staticmethod
    def conflict(t: _Track, d: Detection) -> bool:
        """Whether the track's plate and the box's are of two vehicles."""
        known = t.emitted or next((p for p, n in t.plates.most_common(1) if n >= 2), "")
        if not known or not d.identity or known == d.identity:
            return False
        off = sum(a != b for a, b in zip(known, d.identity))
        if t.misses >= 2:
            return True
        if off == 1 and iou(t.predicted or t.box, d.box) >= 0.50:
            return False
        return bool(t.emitted) or off >= 3 or (known[2] != d.identity[2] and off >= 2)

    def _match(self, ids: list[int], detections: list[Detection], free: set[int], second: bool) -> list[tuple[int, int]]:
        options: dict[int, list[tuple[int, float]]] = {}
        for k in ids:
            for i in sorted(free):
                t = self.tracks[i]
                total, overlap, near, size, along = self.score(t, detections[k].box)
                fits = overlap >= (0.08 if second else 0.12) or (near >= (0.52 if second else 0.62) and size >= 0.55)
                turned = len(t.centres) >= 2 and along < 0.10 and overlap < 0.28
                if fits and not turned and not self.conflict(t, detections[k]):
                    options.setdefault(k, []).append((i, total))
        pairs = best_assignment(options)
        free.difference_update(i for _, i in pairs)
        return pairs

    def observe(self, ts: float, detections: list[Detection]) -> list[int]:
        """Track numbers of one frame's detections; a frame that is not newer than the
        last is dropped (empty)."""
        if ts <= self.last:
            return []
        self.last = ts
        self.tracks = {i: t for i, t in self.tracks.items() if ts - t.seen <= self.max_age * 2.2}
        active = {i for i, t in self.tracks.items() if ts - t.seen <= self.max_age}
        for i in active:
            t = self.tracks[i]
            t.predicted, t.predicted_at = t.kalman.predict(ts - t.predicted_at), ts
        sure = [k for k, d in enumerate(detections) if min(1.0, max(0.0, d.confidence)) >= HIGH]
        free = set(active)
        pairs = self._match(sure, detections, free, False)
        pairs += self._match([k for k in range(len(detections)) if k not in sure], detections, free, True)
        for i in free:
            t = self.tracks[i]
            t.misses += 1
            t.box = t.predicted or t.box
        of = dict(pairs)
        for k, d in enumerate(detections):
            if k not in of:
                of[k] = self.next_id
                self.tracks[self.next_id] = _Track(d.box, ts, BoxKalman(d.box), ts, centres=[centre(d.box)])
                self.next_id += 1
            else:
                t = self.tracks[of[k]]
                t.box, t.seen, t.misses = t.kalman.update(d.box), ts, 0
                t.centres = [*t.centres[-19:], centre(d.box)]
            if d.identity:
                self.tracks[of[k]].plates[d.identity] += 1
        return [of[k] for k in range(len(detections))]


@dataclass
class StaticRegions:
    """Regions of a picture where plates that do not move are seen again and again:
    after two such readings they are kept back for a while, unless a reading is strong."""

    seconds: float = 25.0
    still: float = 0.010
    moving: float = 0.025
    hits: dict[str, int] = field(default_factory=dict)
    until: dict[str, float] = field(default_factory=dict)

    def observe(self, now: float, rows: list[tuple[str, float, bool]]) -> list[bool]:
        """Whether each reading (region, motion, strong) of one frame is shown."""
        for region in [r for r, t in self.until.items() if t <= now]:
            del self.until[region]
            self.hits.pop(region, None)
        shown = []
        for region, motion, strong in rows:
            if not strong and region in self.until and motion < self.moving:
                shown.append(False)
            elif not strong and motion < self.still:
                self.hits[region] = self.hits.get(region, 0) + 1
                if self.hits[region] >= 2:
                    self.until[region] = now + self.seconds
                shown.append(False)
            else:
                self.hits[region] = max(0, self.hits.get(region, 0) - 2)
                shown.append(True)
        return shown


def assisted(primary: list[tuple[Box, bool]], shadow: list[Box], least: float = 0.28) -> list[tuple[str, int]]:
    """What is shown of two engines' boxes: ("primary" or "shadow", number). In order,
    each shadow box takes the place of the row that it overlaps most, a shadow's
    included, unless that is a strict reading of the primary; or it is added."""
    shown = [(box, strict, ("primary", k)) for k, (box, strict) in enumerate(primary)]
    for k, box in enumerate(shadow):
        overlap, at = max(((iou(row[0], box), i) for i, row in enumerate(shown)), default=(0.0, -1))
        if overlap < least:
            shown.append((box, False, ("shadow", k)))
        elif not shown[at][1]:
            shown[at] = (box, False, ("shadow", k))
    return [name for _, _, name in shown]


def template_alignments(text: str, letters: str, most_skips: int = 3, skip: float = 0.16, confusion: float = 0.20, beam: int = 48, most: int = 12) -> list[tuple[str, float]]:
    """Plates (two digits, a letter, five digits) that a noisy key of 7 to 12 characters
    may stand for, each with its least penalty, best first: characters may be skipped,
    and a digit's place takes look-alikes. After each place the ``beam`` best partial
    readings go on."""
    if not 7 <= len(text) <= 12:
        return []
    states = [(0.0, 0, "", 0)]  # penalty, characters used (negative: more is better), output, skipped
    for place in range(8):
        grown = []
        for penalty, used, out, skipped in states:
            for extra in range(min(most_skips - skipped, len(text) + used - 1) + 1):
                c = text[extra - used]
                if place == 2:
                    to, cost = (c if c in letters else ""), 0.0
                else:
                    to, cost = (c, 0.0) if c in "0123456789" else (DIGIT_CONFUSIONS.get(c, ""), confusion)
                if to:
                    grown.append((penalty + cost + skip * extra, used - extra - 1, out + to, skipped + extra))
        states = heapq.nsmallest(beam, grown, key=lambda s: s[:3])
    found: dict[str, float] = {}
    for penalty, used, out, skipped in states:
        rest = len(text) + used
        if skipped + rest <= most_skips:
            found[out] = min(found.get(out, math.inf), penalty + skip * rest)
    return sorted(found.items(), key=lambda x: (x[1], x[0]))[:most]
