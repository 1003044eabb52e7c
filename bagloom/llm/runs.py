"""Best segmentations of many short strings at once: max-plus steps over columns instead of one string at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of a string that is solved here, and strings that are solved at a time (which bounds the arrays).
SHORT, BLOCK = 64, 50_000


class Trie:
    """Pieces as a table from (node, class of a byte) to the next node; leaves share a row without successors."""

    def __init__(self, pieces: dict[str, tuple[int, float]], unknown: float):
        self.unknown = unknown
        coded = {p.encode(): v for p, v in pieces.items()}
        self.kind = np.zeros(256, np.uint8)  # class 0: in no piece
        for k, b in enumerate(sorted({b for p in coded for b in p}), 1):
            self.kind[b] = k
        inner = {b""} | {p[:n] for p in coded for n in range(1, len(p))}
        number = {p: k for k, p in enumerate(sorted(inner | coded.keys(), key=lambda p: (p not in inner, p)))}
        self.inner = len(inner)
        self.next = np.full((self.inner, int(self.kind.max()) + 1), -1, np.int32)
        self.ids, self.worth = np.full(len(number), -1, np.int32), np.zeros(len(number))
        for p, k in number.items():
            if p:
                self.next[number[p[:-1]], self.kind[p[-1]]] = k
            if p in coded:
                self.ids[k], self.worth[k] = coded[p]

    def arcs(self, data: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, id or -1, score) of pieces in data that end by limit; -1 is a character without a piece."""
        kinds = self.kind[data]
        starts = np.flatnonzero((data & 0xC0) != 0x80).astype(np.int32)
        wide = np.diff(np.append(starts, len(data))).astype(np.int32)  # bytes of each character
        lone = np.ones(len(data), bool)
        at, node, n, found = starts, np.zeros(len(starts), np.int32), 0, []
        size = np.zeros(len(data), np.int32)
        size[starts] = wide
        while len(at):
            node = self.next[node, kinds[at + n]]
            n += 1
            on = node >= 0
            at, node = at[on], node[on]
            hit = self.ids[node] >= 0
            a, k = at[hit], node[hit]
            found.append((a, np.full(len(a), n, np.int32), self.ids[k], self.worth[k]))
            lone[a[size[a] == n]] = False
            on = (node < self.inner) & (at + n < limit[at])
            at, node = at[on], node[on]
        rest = lone[starts]
        found.append((starts[rest], wide[rest], np.full(rest.sum(), -1, np.int32), np.full(rest.sum(), self.unknown)))
        return tuple(np.concatenate(c) for c in zip(*found))

    def solve(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, offsets, strings with a character that has no piece) of the strings data[off[i]:off[i+1]], none empty.

        Of equal segmentations that with the longer last pieces counts.
        """
        rows = len(off) - 1
        row = np.repeat(np.arange(rows, dtype=np.int32), np.diff(off))
        start, size, ids, worth = self.arcs(data, off[1:][row])
        of = row[start]
        place = start - off[:-1][of].astype(np.int32)
        order = np.argsort(place.astype(np.uint8), kind="stable")
        of, ids, worth, place = of[order], ids[order], worth[order], place[order]
        begin = start[order] + of  # every string has one more place than bytes
        end = begin + size[order]
        best, back = np.full(len(data) + rows, -np.inf), np.zeros(len(data) + rows, np.int32)
        first = off[:-1] + np.arange(rows)
        best[first] = 0.0
        bounds = np.searchsorted(place, np.arange(SHORT + 1))
        for i, j in zip(bounds, bounds[1:]):  # starts at one place in their strings: their ends all differ
            score = best[begin[i:j]] + worth[i:j]
            better = np.flatnonzero(score > best[end[i:j]])
            best[end[i:j][better]], back[end[i:j][better]] = score[better], better + i
        who, at, steps = np.arange(rows), off[1:] + np.arange(rows), []
        while len(who):
            arc = back[at]
            steps.append((who, arc))
            at = begin[arc]
            on = at > first[who]
            who, at = who[on], at[on]
        count = np.bincount(np.concatenate([w for w, _ in steps]), minlength=rows) if steps else np.zeros(rows, np.int64)
        ends = np.concatenate(([0], np.cumsum(count)))
        out = np.empty(ends[-1], np.int32)
        for k, (w, arc) in enumerate(steps, 1):
            out[ends[w + 1] - k] = ids[arc]
        alien = np.zeros(rows, bool)
        alien[np.repeat(np.arange(rows), count)[out < 0]] = True
        return out, ends, alien

    def segment(self, strings: pa.Array, plainly) -> pa.Array:
        """The ids of each of the strings, none empty; `plainly` gives the int32 bytes of one that is not solved here."""
        off = np.frombuffer(strings.buffers()[1], np.int32, len(strings) + 1, strings.offset * 4)
        data = np.frombuffer(strings.buffers()[2], np.uint8)
        size, parts, slow = np.diff(off), [], []
        short = np.flatnonzero(size <= SHORT)
        where = np.empty(len(strings), np.int64)
        where[short] = np.arange(len(short))
        for i in range(0, len(short), BLOCK):
            some = short[i : i + BLOCK]
            ends = np.concatenate(([0], np.cumsum(size[some], dtype=np.int64)))
            flat = data[np.arange(ends[-1]) + np.repeat(off[:-1][some] - ends[:-1], size[some])]
            ids, at, alien = self.solve(flat, ends)
            parts.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)))
            slow.append(some[alien])
        slow = np.sort(np.concatenate([*slow, np.flatnonzero(size > SHORT)]).astype(np.int64))
        where[slow] = len(short) + np.arange(len(slow))
        parts.append(lists([plainly(x) for x in strings.take(pa.array(slow)).to_pylist()]))
        return pa.concat_arrays(parts).take(pa.array(where))


def lists(blobs: list[bytes]) -> pa.Array:
    flat = np.frombuffer(b"".join(blobs), np.int32)
    off = np.concatenate(([0], np.cumsum([len(b) // 4 for b in blobs], dtype=np.int64)))
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat))
