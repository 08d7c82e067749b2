"""Path data of ordinary length to vertices, many paths of a batch side by side.

A path that fits a block of tokens needs nothing from other rows, so a task follows it whole: tokens, steps,
points and rings are arrays over all paths of a slice, and only the moves, which depend on each other, are made step by
step, each for all paths at once. The rules and the order of every sum are those of the blocks in ``geometry``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Numbers per step and samples per curve.
ARITY = {"m": 2, "l": 2, "h": 1, "v": 1, "c": 6, "s": 4, "q": 4, "a": 7}
SAMPLES = {"c": 6, "s": 6, "q": 5}
NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
TOKEN = rf"([MmLlHhVvCcSsQqTtAaZz]|{NUMBER})"
#: The numbers of a step that lead to its end, for x and y.
ENDS = ({"m": 0, "l": 0, "h": 0, "c": 4, "s": 2, "q": 2, "a": 5}, {"m": 1, "l": 1, "v": 0, "c": 5, "s": 3, "q": 3, "a": 6})
#: Characters of path data that are followed at once.
SLICE = 1 << 20


def _table(values: dict, default: int) -> np.ndarray:
    out = np.full(128, default)
    for letter, v in values.items():
        out[ord(letter)] = v
    return out


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)])


def _steps(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Path, command, whether relative, and numbers of each step before its path's first malformed place."""
    find = re.compile(TOKEN, re.ASCII).findall
    found = [find(t.replace(",", " ")) for t in texts]
    counts = np.array([len(t) for t in found], np.int64)
    tokens = [t for f in found for t in f]
    code = np.array([ord(t) if t.isalpha() else 0 for t in tokens], np.int64)
    num = np.array([0.0 if t.isalpha() else float(t) for t in tokens], float)
    path = np.repeat(np.arange(len(texts)), counts)
    row, begin = np.arange(len(tokens)), (np.cumsum(counts) - counts)[path]
    is_cmd = code > 0
    last = np.maximum.accumulate(np.where(is_cmd, row, -1)) if len(row) else row
    led = last >= begin  # a path that begins with numbers draws as after M
    raw = np.where(led, code[np.maximum(last, 0)], ord("M"))
    letter = raw | 32
    arity = _table(ARITY, 1)[letter]
    k = row - np.where(led, last, begin - 1) - 1
    next_cmd = np.r_[is_cmd[1:], True] | np.r_[path[1:] != path[:-1], True] if len(row) else is_cmd
    close = letter == ord("z")
    bad = (letter == ord("t")) | (is_cmd & ~close & next_cmd) | (~is_cmd & close)
    first = np.where(is_cmd, close | bad, k % arity == 0)
    # A step lacks numbers if the next command or path comes too soon.
    end = np.append(np.minimum.accumulate(np.where(is_cmd | (row == begin), row, len(row))[::-1])[::-1], len(row))[1:]
    bad |= first & ~is_cmd & (end - row < arity)
    stop = np.full(len(texts), len(row))
    np.minimum.at(stop, path[bad], row[bad])
    at = np.flatnonzero(first & (row < stop[path]))
    args = np.append(num, np.zeros(7))[at[:, None] + np.arange(7)]
    again = (letter[at] == ord("m")) & (k[at] >= arity[at])
    return path[at], np.where(again, ord("l"), letter[at]), raw[at] == letter[at], args


def _moves(path: np.ndarray, cmd: np.ndarray, rel: np.ndarray, args: np.ndarray, n: int) -> np.ndarray:
    """``px, py, x, y``: the point before and after each step."""
    out = np.zeros((4, len(path)))
    counts = np.bincount(path, minlength=n)
    order = np.argsort(-counts, kind="stable")
    begin, live = (np.cumsum(counts) - counts)[order], -np.sort(-counts, kind="stable")
    row = np.arange(len(path))
    to, has = [], []
    for ends in ENDS:
        column = _table(ends, -1)[cmd]
        to.append(args[row, np.maximum(column, 0)])
        has.append(column >= 0)
    point, start = np.zeros((2, n)), np.zeros((2, n))
    for k in range(live[0] if n else 0):
        m = int(np.searchsorted(-live, -k, side="left"))  # the paths with more than k steps
        at = begin[:m] + k
        begins, close = cmd[at] == ord("m"), cmd[at] == ord("z")
        for axis in (0, 1):
            now, target = point[axis, :m].copy(), to[axis][at]
            then = np.where(has[axis][at], np.where(rel[at], now + target, target), now)
            then = np.where(close, start[axis, :m], then)
            out[axis, at], out[2 + axis, at] = now, then
            point[axis, :m] = then
            start[axis, :m] = np.where(begins, then, start[axis, :m])
    return out + 0.0


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b) & ~(np.isnan(a) & np.isnan(b))


def _closed(path: np.ndarray, ring: np.ndarray, close: np.ndarray) -> np.ndarray:
    """Whether the ring of each step has a closing command."""
    first = _starts(path, ring)
    if not len(first):
        return close
    return np.repeat(np.logical_or.reduceat(close, first), np.diff(np.append(first, len(path))))


def follow(texts: list[str]) -> tuple[np.ndarray, ...]:
    """``path, ring, seq, x, y`` of the vertices of path data strings; ``path`` is the string's place."""
    with np.errstate(all="ignore"):
        path, cmd, rel, args = _steps(texts)
        at = _moves(path, cmd, rel, args, len(texts))
        close = cmd == ord("z")
        # A subpath ends before a move and behind a closing command; numbers go on over the paths.
        ring = np.cumsum(cmd == ord("m")) + np.cumsum(close) - close
        n = _table(SAMPLES, 1)[cmd]
        n[close] = 0
        step = np.repeat(np.arange(len(path)), n)
        t = (np.arange(len(step)) - np.repeat(np.cumsum(n) - n, n) + 1) / n[step]
        u, letter = 1.0 - t, cmd[step]
        curved, cubic, smooth = n[step] > 1, letter == ord("c"), letter == ord("s")
        points = []
        for axis in (0, 1):
            p0, p3 = at[axis][step], at[2 + axis][step]
            near, far = (args[step, j + axis] + np.where(rel[step], p0, 0.0) for j in (0, 2))
            c1 = np.where(cubic, near, np.where(smooth, p0, p0 + 2.0 / 3.0 * (near - p0)))
            c2 = np.where(cubic, far, np.where(smooth, near, p3 + 2.0 / 3.0 * (near - p3)))
            curve = u * u * u * p0 + 3 * u * u * t * c1 + 3 * u * t * t * c2 + t * t * t * p3
            points.append(np.where(curved, curve, p3))
        x, y = points
        closed = _closed(path, ring, close)[step]
        path, ring = path[step], ring[step]
    first = _starts(path, ring)
    count = np.diff(np.append(first, len(path)))
    last = first + count - 1
    # A closing command leads back unless the ring ends where it began.
    back = closed[first] & (_differ(x[first], x[last]) | _differ(y[first], y[last]))
    wanted = count + back >= 2
    rows = np.repeat(wanted, count)
    first, size, back, owner = first[wanted], (count + back)[wanted], back[wanted], path[first[wanted]]
    begin = np.cumsum(size) - size
    out = np.zeros((2, int(size.sum())))
    ends = np.zeros(out.shape[1], bool)
    ends[(begin + size - 1)[back]] = True
    for axis, values in enumerate((x, y)):
        out[axis, ~ends], out[axis, ends] = values[rows], values[first[back]]
    in_path = _starts(owner)
    number = np.arange(len(owner)) - np.repeat(in_path, np.diff(np.append(in_path, len(owner))))
    return (np.repeat(owner, size), np.repeat(number, size), np.arange(len(ends)) - np.repeat(begin, size), out[0], out[1])


def followed(batches: Iterator[pa.RecordBatch], doc_id: str) -> Iterator[pa.RecordBatch]:
    """Batches of ``doc_id, path_no, d`` to batches of vertices, in slices of a bounded size."""
    for batch in batches:
        texts = batch.column("d").to_pylist()
        begin = _starts(np.cumsum([len(t) for t in texts]) // SLICE)
        for a, b in zip(begin, np.append(begin, len(texts))[1:], strict=True):
            path, ring, seq, x, y = follow(texts[a:b])
            owner = pa.array(path + a)
            yield pa.RecordBatch.from_arrays(
                [batch.column(doc_id).take(owner), batch.column("path_no").take(owner), pa.array(ring, pa.int32()),
                 pa.array(seq, pa.int32()), pa.array(x), pa.array(y)], names=[doc_id, "path_no", "ring", "seq", "x", "y"])
