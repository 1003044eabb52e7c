"""Substring deduplication over words by difference-cover anchors.

COVER is a perfect difference set modulo PERIOD: for any two positions there is a shift below PERIOD that
takes both to cover positions.  So two equal runs of WINDOW words share an equal run of ANCHOR =
WINDOW - PERIOD + 1 words that starts, in both, at a cover position.  Only those windows are hashed and
exchanged (4 in 13 positions).  Windows of WINDOW words around anchors that occur twice or more are then
extended and exchanged in full, and the earliest occurrence stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import cut
from .packs import Pack, answered, bits, dealt, dump, each, gather, groups, offers, pack, total_bytes, unbits
from .textscan import Words, counts_by, covered, grams, joined

WINDOW, PERIOD, COVER = 20, 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
#: Key bytes that one bucket receives, about.
BUCKET_BYTES = 16 << 20

_ON = np.isin(np.arange(PERIOD), COVER)


class _Scan:
    """Words of a pack with their anchors: at (word index), and distinct anchor hashes."""

    def __init__(self, p: Pack):
        self.pack = p
        self.words = w = Words(p.texts)
        self.h = w.hashes()
        self.begin, self.end = np.repeat(w.off[:-1], w.n), w.text_end()
        place = np.arange(len(w))
        self.at = np.flatnonzero(_ON[(place - self.begin) % PERIOD] & (place + ANCHOR <= self.end))
        self.keys, self.inverse, self.count = np.unique(grams(self.h, ANCHOR)[self.at], return_inverse=True, return_counts=True)

    def candidates(self, repeated: np.ndarray) -> None:
        """Sets starts, and the distinct window hashes, of windows that hold a repeated anchor."""
        near = np.zeros(len(self.words), bool)
        hot = self.at[repeated[self.inverse]] if len(self.at) else self.at
        for shift in range(PERIOD):
            s = hot - shift
            near[s[(s >= self.begin[hot]) & (s + WINDOW <= self.end[hot])]] = True
        self.starts = np.flatnonzero(near)
        self.row = self.words.text_of()[self.starts]
        self.id = self.pack.ids[self.row]
        self.windows, self.which = np.unique(grams(self.h, WINDOW)[self.starts], return_inverse=True)
        self.least = np.full(len(self.windows), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.which, self.id)


def _mask(answer: list) -> np.ndarray:
    return np.concatenate([unbits(a[0]) for a in answer]) if answer else np.zeros(0, bool)


def _repeated(bucket, numbers, got):
    """Which anchor hashes occur twice or more, over all packs or in one."""
    u, inv, parts = groups([k for k, _ in got])
    seen = np.bincount(inv, minlength=len(u))
    np.add.at(seen, inv, np.concatenate([unbits(m) for _, m in got]).astype(seen.dtype) if got else 0)
    for n, part in zip(numbers, parts):
        yield n, dump(bits(seen[inv[part]] > 1))


def _owners(bucket, numbers, got):
    """Which windows have their smallest id in the asking pack."""
    u, inv, parts = groups([k for k, _ in got])
    ids = np.concatenate([i for _, i in got])
    least = np.full(len(u), np.iinfo(np.int64).max)
    np.minimum.at(least, inv, ids)
    own = ids == least[inv]
    for n, part in zip(numbers, parts):
        yield n, dump(bits(own[part]))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, text): one row per row of docs, text the kept words joined by one space.

    A word goes if a window of WINDOW words over it also starts earlier: in a row with a smaller id, or
    before in the same row.  Rows that share an id do not remove one another's words; a null id comes before
    all others; a null text has no words; an empty table gives no row.
    """
    packs = pack(docs, id_col, text_col)
    size = total_bytes(packs)
    # about six bytes a word; an anchor key has 8 bytes, a candidate window 16, and every window can be one
    few, many = 1 + int(size / 6 * len(COVER) / PERIOD * 8) // BUCKET_BYTES, 1 + int(size / 6 * 16) // BUCKET_BYTES

    def anchors(p: Pack):
        s = _Scan(p)
        return [(b, dump(s.keys[lo:hi], bits(s.count[lo:hi] > 1))) for b, lo, hi in dealt(s.keys, few)]

    first = cut(answered(offers(packs, anchors), _repeated))

    def windows(p: Pack, answer):
        s = _Scan(p)
        s.candidates(_mask(answer))
        return [(b, dump(s.windows[lo:hi], s.least[lo:hi])) for b, lo, hi in dealt(s.windows, many)]

    second = answered(offers(gather(packs, first), windows, 1), _owners)

    def rest(p: Pack, anchor, owner):
        s = _Scan(p)
        s.candidates(_mask(anchor))
        own = _mask(owner)
        order = np.lexsort((s.starts, s.row, s.which))
        w, r = s.which[order], s.row[order]
        again = np.zeros(len(order), bool)
        again[order[1:]] = (w[1:] == w[:-1]) & (r[1:] == r[:-1])
        late = again | (s.id != s.least[s.which]) | ~own[s.which] if len(order) else again
        gone = covered(s.starts[late], WINDOW, len(s.words))
        return pa.RecordBatch.from_arrays([p.id_column(), pa.array(s.words.n.astype(np.int64)), pa.array(counts_by(s.words.off, gone)), joined(s.words, ~gone)], names=["id", "n_words", "n_removed", "text"])

    return each(gather(packs, first, second), rest, "id long, n_words long, n_removed long, text string", 2)
