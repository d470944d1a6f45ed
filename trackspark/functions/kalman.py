"""Box tracking state: all trackers of one movie as arrays (numpy).

State of a tracker: centre, area and ratio of its box, and the velocities of the first three.
"""

from __future__ import annotations

import numpy as np

from .assignment import assign

# Noise of the constant-velocity model, of boxes, and of a new tracker.
NOISE = [1.0, 1.0, 1.0, 1.0, 0.01, 0.01, 0.0001]
MEASURE_NOISE = [1.0, 1.0, 10.0, 10.0]
START = [10.0, 10.0, 10.0, 10.0, 10000.0, 10000.0, 10000.0]

# All three are diagonal, so a covariance has entries between a value and its own velocity only. A tracker is a column:
# its state, then these entries: value, value with velocity, velocity with value, velocity; the ratio's last.
PLACES = [(i, i) for i in range(3)] + [(i, i + 4) for i in range(3)] + [(i + 4, i) for i in range(3)] + [(i + 4, i + 4) for i in range(3)] + [(3, 3)]
AT = tuple(np.array(PLACES).T)
DIAGONAL = [7, 8, 9, 19]  # entries of what is measured
_column = lambda d: np.diag(d)[AT][:, None]
NOISE, START, MEASURE_NOISE = _column(NOISE), _column(START), np.array(MEASURE_NOISE)[:, None]


def measured(boxes: np.ndarray) -> np.ndarray:
    w, h = boxes[:, 2] - boxes[:, 0], boxes[:, 3] - boxes[:, 1]
    out = np.empty((len(boxes), 4))
    out[:, 0], out[:, 1], out[:, 2], out[:, 3] = boxes[:, 0] + w / 2, boxes[:, 1] + h / 2, w * h, w / h
    return out


def boxes_of(x: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        w = np.sqrt(x[:, 2] * x[:, 3])
        h = x[:, 2] / w
    w, h, out = w / 2, h / 2, np.empty((len(x), 4))
    out[:, 0], out[:, 1], out[:, 2], out[:, 3] = x[:, 0] - w, x[:, 1] - h, x[:, 0] + w, x[:, 1] + h
    return out


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Overlap shares to ten digits, so that equal ones tie whatever the last bits of a prediction are."""
    side = lambda i, j: np.maximum(np.minimum(a[:, None, j], b[None, :, j]) - np.maximum(a[:, None, i], b[None, :, i]), 0)
    inter = side(0, 2) * side(1, 3)
    area = lambda z: (z[:, 2] - z[:, 0]) * (z[:, 3] - z[:, 1])
    with np.errstate(invalid="ignore"):
        m = np.round(inter / (area(a)[:, None] + area(b)[None, :] - inter), 10)
    return m if np.isfinite(m).all() else np.nan_to_num(m)


def best_overlaps(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The assignment with the largest sum of overlaps. Boxes that share no overlap, also over others, don't compete:
    each group is solved apart and in the order of its rows and columns, so that a group has one result whatever
    else the frame holds. Pairs without overlap are left out."""
    rows, columns = np.nonzero(m > 0)
    group = np.arange(m.shape[0])
    owner = {}
    find = lambda i: i if group[i] == i else find(group[i])
    for r, c in zip(rows.tolist(), columns.tolist()):
        if c in owner:
            a, b = sorted((find(owner[c]), find(r)))
            group[b] = a
        owner[c] = r
    of_row = np.array([find(i) for i in range(m.shape[0])])
    d, t = [], []
    for g in np.unique(of_row[rows]):
        i = np.flatnonzero(of_row == g)
        j = np.unique(columns[of_row[rows] == g])
        a, b = assign(-m[np.ix_(i, j)])
        good = m[i[a], j[b]] > 0
        d.append(i[a][good])
        t.append(j[b][good])
    d, t = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (d, t))
    order = np.argsort(d)
    return d[order], t[order]


class BoxTracker:
    """Trackers of one movie. ``step`` takes the boxes of the next frame, also if there are none."""

    def __init__(self, max_age: int = 5, min_hits: int = 3, iou: float = 0.3):
        self.max_age, self.min_hits, self.iou = max_age, min_hits, iou
        self.m = np.zeros((20, 0))
        self.ids, self.streak, self.since, self.part = (np.zeros(0, np.int64) for _ in range(4))
        self.ended = np.zeros(0, np.int64)  # ids that the last step has removed
        self.frames = self.last_id = 0

    def _keep(self, which: np.ndarray) -> None:
        if which.all():
            return
        self.ended = np.concatenate([self.ended, self.ids[~which]])
        self.m = self.m[:, which]
        self.ids, self.streak, self.since, self.part = self.ids[which], self.streak[which], self.since[which], self.part[which]

    def _predict(self) -> np.ndarray:
        m = self.m
        m[6, m[6] + m[2] <= 0] = 0.0
        m[0:3] += m[4:7]
        m[7:10] += m[13:16]
        m[10:13] += m[16:19]
        m[7:10] += m[10:13]
        m[13:16] += m[16:19]
        m[7:] += NOISE
        self.streak[self.since > 0] = 0
        self.since += 1
        boxes = boxes_of(m[:7].T)
        good = ~np.isnan(boxes).any(1)
        if good.all():
            return boxes
        self._keep(good)
        return boxes[good]

    def _match_whole(self, boxes: np.ndarray, predicted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``_match`` of boxes and predictions that are one part, without its flags."""
        if not len(boxes) or not len(predicted):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        m = iou_matrix(boxes, predicted)
        over = m > self.iou
        plain = np.nonzero(over)
        most = max(over.sum(1).max(), over.sum(0).max())
        if most == 1 or (most == 0 and not (m > 0).any()):
            return plain
        d, t = best_overlaps(m)
        keep = m[d, t] >= self.iou
        return d[keep], t[keep]

    def _match(self, boxes: np.ndarray, predicted: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of boxes and predictions of one part: those over the threshold if some are and each side has one at
        most, else the best assignment. ``rule`` is for each part the most of them that one side has, 2 at most;
        ``open`` says that the two rules differ there."""
        self.parts = np.unique(np.concatenate([part, self.part]))
        self.rule, self.open = np.zeros(len(self.parts), np.int64), np.zeros(len(self.parts), bool)
        if not len(boxes) or not len(predicted):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        m = iou_matrix(boxes, predicted)
        m[part[:, None] != self.part[None, :]] = 0
        over = m > self.iou
        of_box, of_track = np.searchsorted(self.parts, part), np.searchsorted(self.parts, self.part)
        np.maximum.at(self.rule, of_box, np.minimum(over.sum(1), 2))
        np.maximum.at(self.rule, of_track, np.minimum(over.sum(0), 2))
        unclear = self.rule == 2
        unclear[of_box[((m > 0) & ~over).any(1)]] = True  # else nothing overlaps but what is over the threshold
        plain = np.nonzero(over)
        if not unclear.any():
            return plain
        d, t = best_overlaps(np.where(unclear[of_box][:, None], m, 0))
        keep = m[d, t] >= self.iou
        best = set(zip(d[keep].tolist(), t[keep].tolist()))
        pairs = set(zip(*(x.tolist() for x in plain)))
        for k in np.flatnonzero(unclear):
            mine, other = {x for x in pairs if of_box[x[0]] == k}, {x for x in best if of_box[x[0]] == k}
            self.open[k] = self.rule[k] < 2 and mine != other
            if self.rule[k] != 1:
                pairs = (pairs - mine) | other
        d, t = np.array(sorted(pairs), np.int64).reshape(-1, 2).T
        return d, t

    def _correct(self, t: np.ndarray, boxes: np.ndarray) -> None:
        m = self.m[:, t]
        left = measured(boxes).T - m[:4]
        part = 1 / (m[DIAGONAL] + MEASURE_NOISE)
        gain = np.concatenate([m[7:10] * part[:3], m[19:] * part[3:], m[13:16] * part[:3]])  # of the seven entries of the state
        m[:4] += gain[:4] * left
        m[4:7] += gain[4:] * left[:3]
        m[13:16] -= gain[4:] * m[7:10]
        m[16:19] -= gain[4:] * m[10:13]
        m[7:10] -= gain[:3] * m[7:10]
        m[10:13] -= gain[:3] * m[10:13]
        m[19] -= gain[3] * m[19]
        self.m[:, t] = m
        self.streak[t] += 1
        self.since[t] = 0

    def step(self, boxes: np.ndarray) -> np.ndarray:
        """Track id of each box, 0 where its track is not shown (yet)."""
        ids, shown = self.step_all(boxes)
        return np.where(shown, ids, 0)

    def step_all(self, boxes: np.ndarray, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Track id of each box, and whether its track is shown. Boxes of different ``part`` don't act on each
        other. ``predicted`` and ``predicted_part`` are what they met."""
        self.frames += 1
        boxes = np.asarray(boxes, float).reshape(-1, 4)
        self.ended = self.ended[:0]
        self.predicted = self._predict()
        self.predicted_part = self.part
        d, t = self._match_whole(boxes, self.predicted) if part is None else self._match(boxes, self.predicted, part)
        part = np.zeros(len(boxes), np.int64) if part is None else part
        if len(d):
            self._correct(t, boxes[d])
        out, shown = np.zeros(len(boxes), np.int64), np.full(len(boxes), self.min_hits <= 0 or self.frames <= self.min_hits)
        out[d] = self.ids[t]
        shown[d] |= self.streak[t] >= self.min_hits
        free = np.ones(len(boxes), bool)
        free[d] = False
        new = np.flatnonzero(free)
        if not len(new):
            self._keep(self.since <= self.max_age)
            return out, shown
        out[new] = self.last_id + 1 + np.arange(len(new))
        self.last_id += len(new)
        m = np.zeros((20, len(new)))
        m[:4], m[7:] = measured(boxes[new]).T, START
        self.m = np.concatenate([self.m, m], 1)
        zero = np.zeros(len(new), np.int64)
        self.ids, self.streak, self.since = np.concatenate([self.ids, out[new]]), np.concatenate([self.streak, zero]), np.concatenate([self.since, zero])
        self.part = np.concatenate([self.part, part[new]])
        self._keep(self.since <= self.max_age)
        return out, shown

    @property
    def x(self) -> np.ndarray:
        """States, a row a tracker."""
        return self.m[:7].T

    @property
    def p(self) -> np.ndarray:
        """Covariances, a matrix a tracker."""
        out = np.zeros((self.m.shape[1], 7, 7))
        out[:, AT[0], AT[1]] = self.m[7:].T
        return out

    def state(self) -> tuple:
        """Flat lists, for a streaming state store."""
        return self.frames, self.last_id, self.x.ravel().tolist(), self.p.ravel().tolist(), self.ids.tolist(), self.streak.tolist(), self.since.tolist()

    def restore(self, state: tuple) -> BoxTracker:
        self.frames, self.last_id, x, p, ids, streak, since = state
        self.m = np.concatenate([np.array(x, float).reshape(-1, 7), np.array(p, float).reshape(-1, 7, 7)[:, AT[0], AT[1]]], 1).T.copy()
        self.ids, self.streak, self.since = (np.array(z, np.int64) for z in (ids, streak, since))
        self.part = np.zeros(len(self.ids), np.int64)
        return self
