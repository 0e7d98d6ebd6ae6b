"""Per-byte label scores to spans: log-softmax, BIOES decoding, spans with confidence; vectorised over windows."""

from __future__ import annotations

import numpy as np

PENALTY = -1e30
B, I, O, E, S = "BIOES"


def label_names(entities: int) -> list[tuple[str, int]]:
    """O, then B, I, E, S of each entity."""
    return [(O, -1)] + [(k, e) for e in range(entities) for k in (B, I, E, S)]


def log_softmax(x: np.ndarray) -> np.ndarray:
    top = x.max(-1, keepdims=True)
    return x - top - np.log(np.exp(x - top).sum(-1, keepdims=True))


def transitions(entities: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Penalties of first labels, of pairs and of last labels: an entity runs B I* E or is S; the rest is O. What is
    not allowed costs ``PENALTY`` but is not excluded, so that every input has a path."""
    names = label_names(entities)
    opens = np.array([k in (B, I) for k, _ in names])
    goes_on = np.array([k in (I, E) for k, _ in names])
    which = np.array([e for _, e in names])
    inside = opens[:, None] & goes_on[None, :] & (which[:, None] == which[None, :])
    outside = ~opens[:, None] & ~goes_on[None, :]
    return np.where(goes_on, PENALTY, 0.0), np.where(inside | outside, 0.0, PENALTY), np.where(opens, PENALTY, 0.0)


def viterbi(logp: np.ndarray, entities: int, bias: np.ndarray | None = None, sizes: np.ndarray | None = None) -> np.ndarray:
    """Best label paths of windows (n, T, labels). Ties go to the lowest label; NaN is never best; O gets no bias.
    ``sizes``: how many positions of each window count; the others are O.

    Where the best label of every position is better than any other by more than sums can lose, and these labels may
    follow each other, they are the path; the other windows go step by step."""
    n, t_max, _ = logp.shape
    if not t_max:
        return np.zeros((n, 0), np.int64)
    if bias is not None and np.any(bias):
        logp = np.array(logp, np.float64)
        logp[..., 1:] += np.repeat(np.asarray(bias, np.float64), 4)
    sizes = np.full(n, t_max) if sizes is None else np.asarray(sizes)
    path, clear = _alone(logp, entities, sizes)
    if not clear.all():
        path[~clear] = _stepwise(logp[~clear], entities, sizes[~clear])
    return path


def _alone(logp: np.ndarray, entities: int, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the best label of each position, in which windows they are the only best path)."""
    n, t_max, labels = logp.shape
    outside = None if (sizes == t_max).all() else np.arange(t_max) >= sizes[:, None]
    best, second = logp[..., 0].copy(), np.full((n, t_max), -np.inf, logp.dtype)
    path = np.zeros((n, t_max), np.int16)
    with np.errstate(invalid="ignore"):
        for j in range(1, labels):
            x = logp[..., j]
            np.maximum(second, np.minimum(best, x), out=second)
            np.copyto(path, j, where=x > best)
            np.maximum(best, x, out=best)
        margin = best - second  # NaN where a label has none
        if outside is not None:
            path[outside], margin[outside], best[outside] = 0, np.inf, 0
        lost = np.abs(best).max(1).astype(np.float64) * sizes.astype(np.float64) ** 2 * 2.0**-51
        clear = margin.min(1) > lost
    several = np.array([False] + [True, True, True, False] * entities)[: max(labels, 1)]
    for i in np.flatnonzero(clear & several[path].any(1)):
        first, pair, last = transitions(entities)
        own = path[i, : sizes[i]]
        clear[i] = first[own[0]] == 0 and last[own[-1]] == 0 and not pair[own[:-1], own[1:]].any()
    return path, clear


def _stepwise(logp: np.ndarray, entities: int, sizes: np.ndarray) -> np.ndarray:
    """``viterbi`` by steps over positions; longer windows come first, so that each step has those that go on."""
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    score = np.nan_to_num(np.asarray(logp[order], np.float64), nan=-np.inf)
    first, pair, last = transitions(entities)
    n, t_max, labels = score.shape
    best, back = score[:, 0] + first, np.zeros(score.shape, np.int16)
    going = np.searchsorted(-sizes, -np.arange(t_max), "left")  # windows with more positions than t
    for t in range(1, int(sizes[0])):
        k = going[t]
        all_ = best[:k, :, None] + pair
        back[:k, t] = all_.argmax(1)
        best[:k] = all_.max(1) + score[:k, t]
    path, rows = np.zeros((n, t_max), np.int64), np.arange(n)
    path[rows, sizes - 1] = (best + last).argmax(1)
    for t in range(int(sizes[0]) - 1, 0, -1):
        k = going[t]
        path[:k, t - 1] = back[rows[:k], t, path[:k, t]]
    out = np.empty_like(path)
    out[order] = path
    return out


def spans_of(path: np.ndarray, logp: np.ndarray, entities: int) -> list[tuple[int, int, int, float]]:
    """(start, end, entity, confidence) of one path; confidence is the mean probability of its labels, without bias."""
    at = np.flatnonzero(path)
    if not len(at):
        return []
    labels = np.asarray(path)[at]
    p = np.exp(np.asarray(logp[at, labels], np.float64))
    alone, places = p.astype(np.float32).tolist(), at.tolist()
    out, start, kind, before = [], None, -1, -2  # start: place in ``at`` of the open B
    for i, (t, label) in enumerate(zip(places, labels.tolist())):
        e, k = divmod(label - 1, 4)
        if t != before + 1:  # an O between
            start = None
        before = t
        if k == 3:
            out.append((t, t + 1, e, alone[i]))
            start = None
        elif k == 0:
            start, kind = i, e
        elif k == 2:
            if start is not None and kind == e:
                out.append((places[start], t + 1, e, float(np.float32(p[start : i + 1].mean()))))
            start = None
    return out
