"""Pure kernels over one key's ordered rows. No Spark here: batch operators and
streams call the same code, and their state is plain data."""

from __future__ import annotations

import functools
import heapq
import math
from dataclasses import dataclass, field

import numpy as np

Box = tuple[float, float, float, float]


def iou(a: Box, b: Box) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(0.0, w) * max(0.0, h)
    total = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / total if total > 0 else 0.0


def centre(b: Box) -> tuple[float, float]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def max_matching(options: list[list[int]]) -> dict[int, int]:
    """Left index to right index, as many as possible: those with fewest options
    first, each trying its options in order and moving others out of the way. The
    chain of those that move is kept in a list, however long it gets."""
    owner: dict[int, int] = {}
    for start in sorted(range(len(options)), key=lambda i: (len(options[i]), i)):
        tried: set[int] = set()
        chain = [(start, iter(options[start]))]
        wanted: list[int] = []  # the right that each of the chain waits for
        while chain:
            right = next((r for r in chain[-1][1] if r not in tried), None)
            if right is None:
                chain.pop()
                if wanted:
                    wanted.pop()
                continue
            tried.add(right)
            wanted.append(right)
            if right not in owner:
                for (left, _), to in zip(chain, wanted, strict=True):
                    owner[to] = left
                break
            chain.append((owner[right], iter(options[owner[right]])))
    return {left: right for right, left in owner.items()}


def min_cost_pairs(cost: list[list[float]], missing: float) -> list[tuple[int, int]]:
    """Pairs of the assignment of least total cost, where leaving a row out costs
    ``missing`` and infinite entries are forbidden. Successive shortest paths over
    row potentials."""
    n = len(cost)
    wide = [[*row, *[missing if i == j else math.inf for j in range(n)]] for i, row in enumerate(cost)]
    m = len(wide[0]) if wide else 0
    row_of = [-1] * m
    u, w = [0.0] * n, [0.0] * m
    for start in range(n):
        best, via, done = [math.inf] * m, [-1] * m, [False] * m
        row, last = start, -1
        while True:
            near, col = math.inf, -1
            base = 0.0 if last < 0 else best[last]
            for j in range(m):
                if not done[j]:
                    step = base + wide[row][j] - u[row] - w[j]
                    if step < best[j]:
                        best[j], via[j] = step, last
                    if best[j] < near:
                        near, col = best[j], j
            done[col] = True
            last = col
            if row_of[col] < 0:
                break
            row = row_of[col]
        for j in range(m):
            if done[j] and j != last:
                w[j] += best[j] - best[last]
                u[row_of[j]] += best[last] - best[j]
        u[start] += best[last]
        while last >= 0:
            before = via[last]
            row_of[last] = row_of[before] if before >= 0 else start
            last = before
    return sorted((i, j) for j, i in enumerate(row_of) if i >= 0 and j < m - n)


def suppress(boxes: list[Box], scores: list[float], threshold: float) -> list[int]:
    """Indexes kept by greedy non-maximum suppression, best first."""
    kept: list[int] = []
    for i in sorted(range(len(boxes)), key=lambda k: (-scores[k], k)):
        if all(iou(boxes[i], boxes[j]) <= threshold for j in kept):
            kept.append(i)
    return kept


def diverse(frames: list[tuple[int, float]], capacity: int = 5, gap: int = 1) -> list[int]:
    """Sequence numbers of the best frames that lie more than ``gap`` apart. A frame
    enters in place of its weaker neighbours unless one of them is as good."""
    held: list[tuple[float, int]] = []
    for seq, score in frames:
        near = [x for x in held if abs(x[1] - seq) <= gap]
        if any(x[0] >= score for x in near):
            continue
        held = sorted([x for x in held if x not in near] + [(score, seq)], reverse=True)[:capacity]
    return [seq for _, seq in held]


@dataclass
class Tracker:
    """Boxes of one camera's frames as tracks of constant velocity. A track expects its
    box to move on by its velocity, for four steps at most and in whole pixels; the
    closest pairs of tracks and boxes are made first. A track takes up a smoothed box,
    and goes when missed more than ``max_missed`` times."""

    min_iou: float = 0.10
    max_distance: float = 1.25
    smoothing: float = 0.75
    velocity_share: float = 0.5
    max_missed: int = 4
    most_steps: int = 4
    next_id: int = 1
    tracks: dict[int, dict] = field(default_factory=dict)
    last_seq: int | None = None

    def expected(self, track: dict, seq: int) -> Box:
        steps = max(0, min(self.most_steps, seq - track["seq"]))
        box = tuple(round(x + v * steps) for x, v in zip(track["box"], track["velocity"], strict=True)) if steps else track["box"]
        return box if box[2] > box[0] and box[3] > box[1] else track["box"]

    def closeness(self, expected: Box, box: Box) -> float | None:
        """Twice the overlap and the nearness of the centres; null if neither will do."""
        (ax, ay), (bx, by) = centre(expected), centre(box)
        away = math.hypot(bx - ax, by - ay) / math.hypot(max(1.0, expected[2] - expected[0]), max(1.0, expected[3] - expected[1]))
        overlap = iou(expected, box)
        return None if overlap < self.min_iou and away > self.max_distance else 2 * overlap + max(0.0, 1 - away / self.max_distance)

    def _take(self, track: dict, expected: Box, box: Box, seq: int) -> None:
        mixed = tuple(round(self.smoothing * new + (1 - self.smoothing) * old) for new, old in zip(box, expected, strict=True))
        mixed = mixed if mixed[2] > mixed[0] and mixed[3] > mixed[1] else box
        since, share = max(1, seq - track["seq"]), self.velocity_share
        track["velocity"] = tuple(share * (new - old) / since + (1 - share) * v for new, old, v in zip(mixed, track["box"], track["velocity"], strict=True))
        track |= {"box": mixed, "seq": seq, "missed": 0}

    def update(self, seq: int, boxes: list[Box]) -> list[int]:
        """Track ids of the boxes; an old or repeated ``seq`` is dropped (empty)."""
        if self.last_seq is not None and seq <= self.last_seq:
            return []
        self.last_seq = seq
        out = [0] * len(boxes)
        expected = {i: self.expected(t, seq) for i, t in self.tracks.items()}
        pairs = [(c, i, k) for i, e in expected.items() for k, box in enumerate(boxes) if (c := self.closeness(e, box)) is not None]
        waiting = dict.fromkeys(self.tracks)
        for _, i, k in sorted(pairs, reverse=True):
            if i in waiting and not out[k]:
                del waiting[i]
                out[k] = i
                self._take(self.tracks[i], expected[i], boxes[k], seq)
        for i in waiting:
            self.tracks[i]["missed"] += 1
            if self.tracks[i]["missed"] > self.max_missed:
                del self.tracks[i]
        for k, box in enumerate(boxes):
            if not out[k]:
                out[k] = self.next_id
                self.tracks[self.next_id] = {"box": tuple(box), "seq": seq, "missed": 0, "velocity": (0.0,) * 4}
                self.next_id += 1
        return out


@dataclass
class Visits:
    """One camera's visits: a plate's sightings belong to one visit until the plate
    has been missing for some observations and some time and a cooldown has passed."""

    absence_observations: int = 3
    absence_seconds: float = 0.75
    cooldown: float = 30.0
    next_visit: int = 1
    open: dict[str, dict] = field(default_factory=dict)

    def observe(self, ts: float, plates: list[str]) -> list[int]:
        """Visit numbers of the plates seen in one observation, which may be empty."""
        out = []
        for plate in plates:
            v = self.open.get(plate)
            if v is None or not (v["active"] or ts - v["seen"] < self.cooldown):
                v = self.open[plate] = {"visit": self.next_visit, "seen": ts, "active": True, "missing": 0, "since": ts}
                self.next_visit += 1
            v |= {"seen": max(ts, v["seen"]), "active": True, "missing": 0}
            out.append(v["visit"])
        self._absent(ts, plates)
        return out

    def _absent(self, ts: float, seen) -> None:
        """One observation without the open visits that are not in ``seen``."""
        for plate in [p for p in self.open if p not in seen]:
            v = self.open[plate]
            if v["active"]:
                v["since"] = ts if v["missing"] == 0 else v["since"]
                v["missing"] += 1
                if v["missing"] >= max(1, self.absence_observations) and ts - v["since"] >= self.absence_seconds:
                    v["active"] = False
            if not v["active"] and ts - v["seen"] >= self.cooldown:
                del self.open[plate]


@dataclass
class Sighting:
    """A reading of one frame: its track, the plate (empty if unreadable), whether it is
    read strictly, and its box."""

    track: int
    plate: str
    strict: bool = False
    box: Box | None = None


@dataclass
class TrackedVisits(Visits):
    """Visits whose plate may still change. A visit that no strict reading has named yet
    takes another name from its own track if that differs in one place or is strict, and
    from another track if that is strict, differs in one place, comes soon after and
    where the visit was, and is the only such one. An unreadable box belongs to the
    only visit there is. A contradicting plate on a track begins another visit."""

    bound: dict[int, str] = field(default_factory=dict)

    def _rename(self, old: str, new: str) -> None:
        self.open[new] = self.open.pop(old)
        self.bound = {t: new if p == old else p for t, p in self.bound.items()}

    def _kept(self, r: Sighting) -> str:
        """The plate of the visit that the track goes on with, if any."""
        old = self.bound.get(r.track, "")
        if old not in self.open:
            return ""
        if not r.plate or r.plate == old:
            return old
        v = self.open[old]
        if v["sure"] or not (_one_apart(old, r.plate) or (r.strict and v["owner"] == r.track)):
            return ""
        if r.strict and r.plate not in self.open:
            self._rename(old, r.plate)
            return r.plate
        return old

    def _continued(self, r: Sighting, ts: float) -> str:
        """The plate of the one visit that a strict reading of another track goes on."""
        if not (r.strict and r.plate and r.box):
            return ""
        soon = max(1.5, 2 * self.absence_seconds)
        near = [p for p, v in self.open.items() if v["active"] and not v["sure"] and _one_apart(p, r.plate) and 0 <= ts - v["seen"] <= soon and v["box"] and iou(v["box"], r.box) > 0]
        if len(near) != 1:
            return ""
        self._rename(near[0], r.plate)
        return r.plate

    def watch(self, ts: float, rows: list[Sighting]) -> list[int | None]:
        """Visit numbers of the readings of one frame, which may be empty; null for an
        unreadable one that belongs to none."""
        self.bound = {t: p for t, p in self.bound.items() if t in {r.track for r in rows}}
        out, seen = [], set()
        for r in rows:
            plate = self._kept(r)
            if not plate and r.plate in self.open and (self.open[r.plate]["active"] or ts - self.open[r.plate]["seen"] < self.cooldown):
                plate = r.plate
            plate = plate or self._continued(r, ts)
            active = [p for p, v in self.open.items() if v["active"]]
            if not plate and not r.plate and len(active) == 1:
                plate = active[0]
            if not plate and r.plate:
                plate = r.plate
                self.open[plate] = {"visit": self.next_visit, "seen": ts, "since": ts, "owner": r.track, "sure": False, "box": None}
                self.next_visit += 1
            if not plate:
                out.append(None)
                continue
            v = self.open[plate]
            v |= {"seen": max(ts, v["seen"]), "active": True, "missing": 0, "sure": v["sure"] or (r.strict and r.plate == plate), "box": r.box or v["box"]}
            self.bound[r.track] = plate
            seen.add(plate)
            out.append(v["visit"])
        self._absent(ts, seen)
        return out


def _one_apart(a: str, b: str) -> bool:
    return len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) <= 1


@dataclass
class Suppressor:
    """Windowed repeats of one plate in arrival order, which may run backwards:
    what was seen last never moves back."""

    same: float = 20.0
    cross: float = 1.5
    by_camera: dict[str, float] = field(default_factory=dict)
    last: tuple[str, float] | None = None

    def decide(self, camera: str, ts: float) -> str:
        seen = self.by_camera.get(camera)
        decision = "new"
        if self.same > 0 and seen is not None and abs(ts - seen) <= self.same:
            decision = "same_camera_window"
        elif self.cross > 0 and self.last and self.last[0] != camera and abs(ts - self.last[1]) <= self.cross:
            decision = "overlapping_camera_window"
        self.by_camera[camera] = ts if seen is None else max(seen, ts)
        if self.last is None or ts >= self.last[1]:
            self.last = (camera, ts)
        return decision

    def expire(self, now: float) -> None:
        oldest = now - max(self.same, self.cross)
        self.by_camera = {c: t for c, t in self.by_camera.items() if t >= oldest}


@dataclass
class LatestQueue:
    """Bounded queue with one item a key: newer replaces older, the worst priority
    is evicted, items grow too old, and a key served again and again waits longer."""

    capacity: int = 64
    max_age: float = 1.0
    fairness: float = 8.0
    items: dict[str, tuple] = field(default_factory=dict)
    served: dict[str, int] = field(default_factory=dict)

    def put(self, key: str, item: object, priority: float, now: float) -> str:
        said = "replaced" if key in self.items else "added"
        self.items[key] = (priority, now, item)
        if len(self.items) > self.capacity:
            worst = max(self.items, key=lambda k: (self.items[k][0], -self.items[k][1], k))
            del self.items[worst]
            return "rejected" if worst == key else "evicted"
        return said

    def take(self, now: float) -> tuple[str, object] | None:
        self.items = {k: v for k, v in self.items.items() if now - v[1] <= self.max_age}
        if not self.items:
            return None
        least = min((self.served.get(k, 0) for k in self.items), default=0)
        rank = lambda k: (self.items[k][0] + self.fairness * (self.served.get(k, 0) - least), self.items[k][1], k)
        key = heapq.nsmallest(1, self.items, key=rank)[0]
        self.served[key] = self.served.get(key, 0) + 1
        return key, self.items.pop(key)[2]


def ctc_greedy(rows: list[list[float]], alphabet: str) -> str:
    """Best symbol a step, repeats merged, blanks (index 0) dropped."""
    out, before = [], 0
    for row in rows:
        best = max(range(len(row)), key=row.__getitem__)
        if best not in (0, before):
            out.append(alphabet[best - 1])
        before = best
    return "".join(out)


def ctc_beam(rows: list[list[float]], alphabet: str, slots: list[str], width: int = 16) -> list[tuple[str, float]]:
    """Prefix beam search over a layout: place i takes characters of slots[i]. Texts
    of full length with their probabilities, best first."""
    beam: dict[str, tuple[float, float]] = {"": (1.0, 0.0)}  # ends in blank, ends in its last character
    for row in rows:
        grown: dict[str, list[float]] = {}
        for text, (blank, char) in beam.items():
            cell = grown.setdefault(text, [0.0, 0.0])
            cell[0] += (blank + char) * row[0]
            if text:
                cell[1] += char * row[alphabet.index(text[-1]) + 1]
            if len(text) < len(slots):
                for c in slots[len(text)]:
                    p = row[alphabet.index(c) + 1]
                    grown.setdefault(text + c, [0.0, 0.0])[1] += (blank if text[-1:] == c else blank + char) * p
        beam = dict(sorted(((t, (b, c)) for t, (b, c) in grown.items()), key=lambda x: (-sum(x[1]), x[0]))[:width])
    return sorted(((t, b + c) for t, (b, c) in beam.items() if len(t) == len(slots)), key=lambda x: (-x[1], x[0]))


@functools.lru_cache(maxsize=1 << 16)
def align_slots(text: str, allowed: tuple[str, ...], match: float = 1.0, skip: float = -0.22, noise: float = -0.45) -> tuple[float, list[str]]:
    """Best placing of a noisy text on a layout: a character taken by a slot scores
    ``match``, an empty slot ``skip``, a character left over ``noise``."""
    n, m = len(text), len(allowed)
    best: list[list[tuple[float, list[str]]]] = [[(-math.inf, [])] * (m + 1) for _ in range(n + 1)]
    best[0][0] = (0.0, [])
    for i in range(n + 1):
        for j in range(m + 1):
            options = [best[i][j]]
            if j and best[i][j - 1][0] > -math.inf:
                options.append((best[i][j - 1][0] + skip, [*best[i][j - 1][1], ""]))
            if i and best[i - 1][j][0] > -math.inf:
                options.append((best[i - 1][j][0] + noise, best[i - 1][j][1]))
            if i and j and text[i - 1] in allowed[j - 1] and best[i - 1][j - 1][0] > -math.inf:
                options.append((best[i - 1][j - 1][0] + match, [*best[i - 1][j - 1][1], text[i - 1]]))
            best[i][j] = max(options, key=lambda x: x[0])
    return best[n][m]


@dataclass
class Evidence:
    """Readings of one track fused place by place. A reading counts in full if it
    comes long enough after the last one that did, else at ``correlated``; readings
    are placed on the layout by the characters each place allows."""

    layout: list[str]
    gap_seconds: float = 0.08
    correlated: float = 0.35
    min_confidence: float = 0.60
    min_margin: float = 0.20
    min_support: int = 2
    slots: list[dict[str, list]] = field(default_factory=list)
    last: float | None = None
    frames: int = 0
    independent: int = 0

    def add(self, ts: float, text: str, confidence: float, quality: float) -> None:
        self.slots = self.slots or [{} for _ in self.layout]
        self.frames += 1
        fresh = self.last is None or ts - self.last >= self.gap_seconds
        if fresh:
            self.last, self.independent = ts, self.independent + 1
        weight = confidence * confidence * (0.55 + 0.45 * quality) * (1.0 if fresh else self.correlated)
        for slot, char in zip(self.slots, align_slots(text, tuple(self.layout))[1], strict=True):
            if char:
                cell = slot.setdefault(char, [0.0, 0.0, 0])
                cell[0] += weight
                cell[1] += weight * confidence
                cell[2] += fresh

    def decide(self) -> tuple[str, float, str]:
        """(text, confidence, phase): ``locked`` when every place is sure enough,
        ``reading`` while not, ``empty`` without any reading."""
        if not self.slots:
            return "", 0.0, "empty"
        text, worst, sure = "", 1.0, True
        for slot in self.slots:
            ranked = sorted(((w, c) for c, (w, _, _) in slot.items()), reverse=True)
            if not ranked:
                return "", 0.0, "reading"
            total, (top, char) = sum(w for w, _ in ranked), ranked[0]
            second = ranked[1][0] if len(ranked) > 1 else 0.0
            support = slot[char][2]
            confidence = slot[char][1] / max(top, 1e-9) * (0.70 + 0.30 * top / max(total, 1e-9)) + 0.04 * min(2, max(0, support - 1))
            sure &= confidence >= self.min_confidence and (top - second) / max(total, 1e-9) >= self.min_margin and support >= self.min_support
            text, worst = text + char, min(worst, confidence)
        return text, min(1.0, worst), "locked" if sure else "reading"


def _independent(starts: np.ndarray, lengths: np.ndarray, ts: np.ndarray, gap_seconds: float) -> np.ndarray:
    """Which readings Evidence.add() counts in full: all tracks take a step at a time,
    the longest first. A reading at minus infinity has no time and counts in full."""
    fresh = np.zeros(len(ts), bool)
    fresh[starts] = True
    order = np.argsort(-lengths, kind="stable")
    at, less = starts[order], -lengths[order]
    last = ts[at]
    for k in range(1, -less[0] if len(less) else 0):
        n = np.searchsorted(less, -k)
        new = ts[at[:n] + k]
        ok = (new == -math.inf) | (new - last[:n] >= gap_seconds)
        fresh[at[:n] + k] = ok
        last[:n] = np.where(ok, new, last[:n])
    return fresh


def _ranked(w: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every row's second largest weight, 0 where there is none, and its total, summed
    from the largest down with the compensation of sum(): equal to the last bit."""
    left, rows = w.copy(), np.arange(len(w))
    second, high, low = np.zeros(len(w)), np.zeros(len(w)), np.zeros(len(w))
    for k in range(count.max(initial=0)):
        live = rows[count > k]
        at = left[live].argmax(1)
        x, h = left[live, at], high[live]
        left[live, at] = -math.inf
        if k == 1:
            second[live] = x
        high[live] = t = h + x
        low[live] += np.where(np.abs(h) >= np.abs(x), (h - t) + x, (x - t) + h)
    return second, np.where(np.isfinite(low), high + low, high)


def least_evidence(layout: list[str], starts: np.ndarray, ts: np.ndarray, texts: list[str], which: np.ndarray, confidence: np.ndarray, quality: np.ndarray, worth: list[tuple[float, float]]) -> list[tuple[np.ndarray, ...]]:
    """Evidence of many tracks at once: for each (gap_seconds, correlated) of ``worth``
    every track's text and the least confidence, margin and support of its places,
    which are what decide() holds against its thresholds. A track with an empty place
    has no confidence (NaN). A track's readings lie together and in order from
    ``starts`` on; reading i is ``texts[which[i]]``."""
    lengths = np.diff(starts, append=len(ts))
    n, rows = len(starts), np.arange(len(starts))
    owner = np.repeat(rows, lengths)
    placed = [align_slots(t, tuple(layout))[1] for t in texts]
    with np.errstate(all="ignore"):
        base = confidence * confidence * (0.55 + 0.45 * quality)
        runs = []
        for gap_seconds, correlated in worth:
            fresh = _independent(starts, lengths, ts, gap_seconds)
            weight = base * np.where(fresh, 1.0, correlated)
            runs.append((fresh, weight, weight * confidence, [], np.full((3, n), math.inf)))
        for place, allowed in enumerate(layout):
            chars = sorted(set(allowed), reverse=True)  # of equal weights the larger character is first
            code, none = {c: k for k, c in enumerate(chars)}, len(chars)
            cell = owner * (none + 1) + np.array([code.get(p[place], none) for p in placed], np.int64)[which]
            summed = lambda x, cell=cell, none=none: np.bincount(cell, x, n * (none + 1)).reshape(n, none + 1)[:, :none]
            there = summed(None) > 0
            count = there.sum(1)
            for fresh, weight, sure, found, least in runs:
                w = np.where(there, summed(weight), -math.inf)
                best = w.argmax(1)
                top, support = w[rows, best], summed(fresh)[rows, best]
                second, total = _ranked(w, count)
                total = np.maximum(total, 1e-9)
                c = summed(sure)[rows, best] / np.maximum(top, 1e-9) * (0.70 + 0.30 * top / total) + 0.04 * np.clip(support - 1, 0, 2)
                np.minimum(least, [np.where(count > 0, c, math.nan), (top - second) / total, support], out=least)
                found.append(np.array(chars)[best])
    return [(np.stack(found, 1).view(f"<U{len(layout)}")[:, 0], *least) for *_, found, least in runs]


@dataclass
class Agreement:
    """Two engines' readings of one camera, each paired with the nearest one of the
    other that still waits, within a window."""

    window: float = 1.5
    waiting: list[tuple[float, str, str]] = field(default_factory=list)

    def add(self, ts: float, engine: str, text: str) -> list[tuple[float, str]]:
        """(time, verdict) of what this reading settles: agree or disagree for a
        pair, ``only-<engine>`` for a reading whose window has passed."""
        out = [(t, f"only-{e}") for t, e, _ in self.waiting if ts - t > self.window]
        self.waiting = [x for x in self.waiting if ts - x[0] <= self.window]
        other = [x for x in self.waiting if x[1] != engine]
        if other:
            best = min(other, key=lambda x: (abs(ts - x[0]), x[0], x[2]))
            self.waiting.remove(best)
            return [*out, (ts, "agree" if best[2] == text else "disagree")]
        if not any(e == engine and t == text for _, e, t in self.waiting):
            self.waiting.append((ts, engine, text))
        return out

    def flush(self) -> list[tuple[float, str]]:
        out, self.waiting = [(t, f"only-{e}") for t, e, _ in self.waiting], []
        return out
