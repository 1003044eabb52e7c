"""SentencePiece encoding and decoding by a max-plus parallel scan.

The best segmentation is the one whose pieces have the largest total score (Viterbi over the model's
vocabulary).  A document of up to CHUNK characters is solved at once; its words are independent, as no
piece continues behind a word's start, so each distinct word of an Arrow batch is solved once, all short ones
together by max-plus steps over columns (runs.py).  A larger document
is cut into chunks, each at the last place in its reach that no piece crosses, else anywhere.  A chunk's
transfer matrix T has T[i][j], the best score from i characters before its start to j characters before its
end.  Matrices combine associatively under (max, +): FAN neighbours at a time become one, on many tasks, level
by level, until a document has at most FAN.  The states at their borders follow from these, then level by
level those at the borders inside, and every chunk is traced back on its own between its two states.

Ties: of equal segmentations that with the longer last pieces counts; at a border inside a run that pieces
cross, the one whose last piece ends nearest to it.  Cut where no piece crosses, chunks give the ids of the whole.
"""

from __future__ import annotations

import gc
import re
from array import array
from functools import lru_cache, reduce

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches
from .runs import Trie

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of a chunk; longer texts are split.
CHUNK = 50_000
#: Characters before a chunk's planned end among which a better place to cut is looked for.
REACH = 4096
#: Matrices that are combined at a time.
FAN = 32
#: How the model file writes a space; inside, pieces have the space itself, so a literal mark is just an unknown character.
SPACE = "▁"
#: Distinct words whose segmentation is kept by a worker in each of two generations, and the most characters of such a word.
KEPT = 250_000
KEPT_CHARS = 48
#: Added to the least score for a character that the vocabulary lacks.
UNKNOWN = -10.0
LOW = -1e300


class Model:
    """Pieces and scores of a SentencePiece model file; characters without a piece fall back to bytes."""

    def __init__(self, raw: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto.FromString(raw)
        if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models without text normalisation can decode exactly")
        self.prefix = " " if proto.normalizer_spec.add_dummy_prefix else ""
        self.ids, self.bytes, self.out = {}, {}, []
        for i, p in enumerate(proto.pieces):
            if p.type in (p.NORMAL, p.USER_DEFINED):
                self.ids[p.piece.replace(SPACE, " ")] = (i, float(p.score))
            if p.type == p.BYTE:
                self.bytes[int(p.piece[1:-1], 16)] = i
                self.out.append(bytes([int(p.piece[1:-1], 16)]))
            else:
                self.out.append(b"" if p.type == p.CONTROL else p.piece.replace(SPACE, " ").encode())
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte fallback")
        self.unknown = min(s for _, s in self.ids.values()) + UNKNOWN
        self.longest = max(map(len, self.ids))
        self.heads = {p[:n] for p in self.ids for n in range(1, len(p) + 1)}
        self.alien = (1, self.unknown, -1)
        self.found = ahocorasick.Automaton()
        for p in self.heads:
            if p in self.ids or len(p) == 1:
                self.found.add_word(p, (len(p), self.ids[p][1], self.ids[p][0]) if p in self.ids else self.alien)
        for c in {c for p in self.ids for c in p} - self.heads:
            self.found.add_word(c, self.alien)
        self.found.make_automaton()
        self.trie = Trie(self.ids, self.unknown)
        inside = {c for p in self.ids if len(p) > 1 for c in p}
        self.alone = "" if "\n" in inside else "\n"
        if any(" " in p.lstrip(" ") for p in self.ids):
            raise ValueError("pieces that continue over a space are not supported")
        # pairs of a letter or digit and what may follow it in a piece; none has the reverse, or words are not cut there
        pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1) if " " not in p[i : i + 2]}
        self.joined = {x for x in pairs if x[0].isalnum() and not x[1].isalnum()}
        self.cuts = not any(x[1].isalnum() and not x[0].isalnum() for x in pairs)
        if self.cuts:
            other = f"(?:_|[^\\w {self.alone}])"
            joins = "|".join(f"(?<={re.escape(x[0])}){re.escape(x[1])}" for x in sorted(self.joined)) or "(?!)"
            self.units = re.compile(f" *(?:[^\\W_]+(?:(?:{joins}){other}*)?|{other}+)| +|{self.alone or ' '}")
        else:
            self.units = re.compile(f" *[^ {self.alone}]+| +|{self.alone or ' '}")
        self.cache: dict[str, bytes] = _Kept(self._ids_of)
        self.worths: dict[str, float] = _Kept(self._worth_of)

    def prepare(self, text: str) -> str:
        """The text as it is segmented."""
        return self.prefix + text if text else ""

    def arcs(self, s: str, i: int) -> list[tuple[int, float]]:
        """(length, score) of the pieces that start at i, longest last; one unknown character if none has it."""
        found, n = [], len(s)
        for j in range(i + 1, min(n, i + self.longest) + 1):
            p = s[i:j]
            if p not in self.heads:
                break
            got = self.ids.get(p)
            if got:
                found.append((j - i, got[1]))
        if not found or found[0][0] > 1:
            found.insert(0, (1, self.unknown))
        return found

    def path(self, s: str) -> list[tuple[int, float, int]]:
        """(length, score, id or -1) of the pieces of the best path; of equal ones, that with the longer last pieces."""
        n, done, alien = len(s), 0, self.unknown
        best, back = [LOW] * (n + 1), [None] * (n + 1)
        best[0] = 0.0
        for end, arc in self.found.iter(s):  # by end, the longest first, which stays
            end += 1
            while done < end - 1:  # characters that no piece has
                done += 1
                if back[done] is None:
                    best[done], back[done] = best[done - 1] + alien, self.alien
            score = best[end - arc[0]] + arc[1]
            if score > best[end]:
                best[end], back[end] = score, arc
        for j in range(done + 1, n + 1):
            if back[j] is None:
                best[j], back[j] = best[j - 1] + alien, self.alien
        out, j = [], n
        while j:
            arc = back[j]
            out.append(arc)
            j -= arc[0]
        out.reverse()
        return out

    def trace(self, s: str, begin: int = 0, end: int | None = None) -> list[int]:
        """Piece lengths of the best path from begin to end."""
        return [n for n, _, _ in self.path(s[begin:end])]

    def to_ids(self, s: str, begin: int, lengths: list[int]) -> list[int]:
        out = []
        for n in lengths:
            p = s[begin : begin + n]
            got = self.ids.get(p)
            if got:
                out.append(got[0])
            else:
                out += [self.bytes[x] for x in p.encode()]
            begin += n
        return out

    def encode(self, text: str) -> bytes:
        """The ids as int32 in native order."""
        return self.between(self.prepare(text))

    def between(self, s: str) -> bytes:
        """The ids of a prepared text, or of the part of one between two piece ends."""
        return b"".join(map(self.cache.__getitem__, self.units.findall(s)))

    def columns(self, texts: pa.Array) -> pa.Array:
        """between() for a column of prepared texts; null gives an empty list.

        Texts fall into runs without a space inside, each with the spaces before it.  No piece crosses their
        borders, so each distinct run of the column is segmented once, and rows are put together from these.
        """
        texts = pc.fill_null(texts.cast(pa.string()), "")
        off = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4) if len(texts) else np.zeros(1, np.int32)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
        off = off - off[0]
        if not len(raw):
            return pa.ListArray.from_arrays(pa.array(np.zeros(len(texts) + 1, np.int32)), pa.array([], pa.int32()))
        space = raw == 32
        start = space.copy()
        start[1:] &= ~space[:-1]
        if self.alone:
            line = raw == 10
            start |= line
            start[1:] |= line[:-1]
        start[off[:-1][off[:-1] < len(raw)]] = True
        at = np.append(np.flatnonzero(start), len(raw)).astype(np.int32)
        runs = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(raw.tobytes())).dictionary_encode()
        solved = self.trie.segment(runs.dictionary, self.between)
        which = runs.indices.to_numpy()
        ends = np.concatenate(([0], np.cumsum(np.diff(solved.offsets.to_numpy())[which], dtype=np.int64)))
        return pa.ListArray.from_arrays(pa.array(ends[np.searchsorted(at, off)].astype(np.int32)), solved.take(runs.indices).flatten())

    def decode(self, ids) -> str:
        text = b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text

    def texts(self, ids: pa.Array) -> pa.Array:
        """decode() for a column: the pieces of all rows are gathered at once, and rows are cut from their bytes."""
        flat, rows = ids.flatten(), len(ids)
        count = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(count, dtype=np.int64)))
        got = pa.array(self.out, pa.large_binary()).take(flat)
        places = np.frombuffer(got.buffers()[1], np.int64, len(got) + 1, got.offset * 8) if len(got) else np.zeros(1, np.int64)
        data, at = np.frombuffer(got.buffers()[2] or b"", np.uint8), places[ends]
        if self.prefix:  # one space
            starts = at[:-1][at[1:] > at[:-1]]
            starts = starts[data[starts] == ord(self.prefix)]
            data, at = np.delete(data, starts), at - np.searchsorted(starts, at)
        raw = pa.Array.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
        raw = pc.if_else(pc.is_valid(ids), raw, pa.scalar(None, pa.large_binary()))
        try:
            return raw.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:  # ids that do not come from a text
            return pa.array((None if x is None else x.decode("utf-8", "replace") for x in raw.to_pylist()), pa.string())

    def score(self, ids: np.ndarray) -> float:
        return float(self._scores()[ids].sum())

    @lru_cache  # noqa: B019
    def _scores(self) -> np.ndarray:
        out = np.zeros(len(self.out))
        for i, s in self.ids.values():
            out[i] = s
        return out

    def _ids_of(self, unit: str) -> bytes:
        path = self.path(unit)
        ids = [i for _, _, i in path]
        if -1 in ids:
            ids = self.to_ids(unit, 0, [n for n, _, _ in path])
        return array("i", ids).tobytes()

    def _worth_of(self, unit: str) -> float:
        """The score of a unit's best segmentation."""
        return sum(score for _, score, _ in self.path(unit))

    def parting(self, s: str, begin: int) -> tuple[int, int]:
        """The first and last place in s, from begin on, that no piece crosses; (-1, -1) if there is none."""
        at = [m.start() for m in self.units.finditer(s, begin) if m.start() > begin or self._parts(s, begin)]
        if self._parts(s, len(s)):
            at.append(len(s))
        return (at[0], at[-1]) if at else (-1, -1)

    def _parts(self, s: str, i: int) -> bool:
        if not 0 < i <= len(s):
            return False
        if self.alone and (s[i - 1] == self.alone or s[i : i + 1] == self.alone):
            return True
        pair = s[i - 1 : i + 1]
        if pair[0] == " " or pair[1:] == " ":
            return pair[0] != " "
        return self.cuts and len(pair) == 2 and pair[0].isalnum() != pair[1].isalnum() and pair not in self.joined

    def matrix(self, s: str, left: int, ends: bool) -> np.ndarray:
        """Transfer matrix of the chunk s[left:], with `left` characters of the one before.

        T[i][j]: the best score of pieces from left - i to len(s) - j.  State 0 is a piece end at the
        boundary itself.  A last chunk (ends) has only j = 0.

        Where no piece can cross a place inside the chunk, every path has a piece end there, so only the
        parts before the first such place and behind the last one need states.
        """
        first, last = self.parting(s, left)
        if first < 0 or (first == left and last == left):
            return self._matrix(s, left, ends)
        head = self._matrix(s[:first], left, True)[:, 0] if first > left else np.where(np.arange(self.longest) == 0, 0.0, LOW)
        middle = sum(map(self.worths.__getitem__, self.units.findall(s[first:last])))
        tail = self._matrix(s[last:], 0, ends)[0] if last < len(s) else np.where(np.arange(self.longest) == 0, 0.0, LOW)
        return np.maximum(head[:, None] + middle + tail[None, :], LOW)

    def _matrix(self, s: str, left: int, ends: bool) -> np.ndarray:
        """The same, with states throughout."""
        size = self.longest
        n = len(s)
        best = np.full((n + 1, size), LOW)
        for i in range(min(left, size - 1) + 1):
            best[left - i, i] = 0.0
        for at in range(max(0, left - size + 1), n):
            row = best[at]
            # before the chunk every position is a state of its own, and only pieces that cross count
            for k, score in self.arcs(s, at):
                if at + k > left and at + k <= n:
                    np.maximum(best[at + k], row + score, out=best[at + k])
        out = np.full((size, size), LOW)
        for j in range(1 if ends else size):
            if n - j > left or (n - j >= 0 and j == 0):
                out[:, j] = best[n - j]
            elif 0 <= n - j <= left and left - (n - j) < size:
                out[left - (n - j), j] = 0.0
        return np.maximum(out, LOW)


class _Kept(dict):
    """Unit of text to what is known of its best segmentation; long units are not kept.

    Full, it becomes the old generation, from which units in use come back before the next one replaces it.
    """

    def __init__(self, solve):
        self.solve, self.old = solve, {}

    def __missing__(self, unit: str):
        got = self.old.get(unit)
        if got is None:
            got = self.solve(unit)
            if len(unit) > KEPT_CHARS:
                return got
        if len(self) >= KEPT:
            self.old = dict(self)
            self.clear()
        self[unit] = got
        return got


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product; associative."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(axis=1), LOW)


def boundaries(matrices: list[np.ndarray], enter: int = 0, leave: int = 0) -> list[int]:
    """The state at each chunk's start and at the end, on a best path from state `enter` to state `leave`."""
    reach = [np.where(np.arange(matrices[0].shape[0]) == enter, 0.0, LOW)]
    for m in matrices:
        reach.append(np.maximum((reach[-1][:, None] + m).max(axis=0), LOW))
    states = [leave]
    for m, r in zip(matrices[::-1], reach[-2::-1]):
        states.append(int(np.argmax(r + m[:, states[-1]])))
    return states[::-1]


@lru_cache(2)
def _model(raw: bytes) -> Model:
    model = Model(raw)
    gc.freeze()  # the collector need not visit the vocabulary again and again
    return model


class Pieces:
    """Encoder and decoder for DataFrames; the model file is read once by the driver and sent (under 1 MB)."""

    def __init__(self, spark, path: str = MODEL, chunk: int = CHUNK):
        with open(path, "rb") as f:
            self.sent, self.chunk = spark.sparkContext.broadcast(f.read()), chunk

    def encode(self, docs: DataFrame, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
        """docs with an array<int> column; null and empty texts give an empty array, an empty table no row.

        Rows keep all columns, whatever their names; one of the name ids_col is replaced.  Repeated rows are
        encoded alike.  A text of over CHUNK characters is solved in parts on many tasks; its ids become one row.
        """
        sent, chunk = self.sent, self.chunk
        small_batches(docs)

        @F.arrow_udf("array<int>")
        def short(text: pa.Array) -> pa.Array:
            m = _model(sent.value)
            if m.prefix:
                text = pc.if_else(pc.equal(pc.binary_length(text), 0), text, pc.binary_join_element_wise(m.prefix, text, ""))
            return m.columns(text)

        # long texts are few: read once, kept apart, and joined by content; the others pass by
        flag = F.coalesce(F.char_length(text_col) > chunk, F.lit(False))
        names = [c for c in docs.columns if c != ids_col]
        hard = cut(docs.where(flag).select(F.sha2(text_col, 256).alias("key"), F.col(text_col).alias("text"), F.struct(*names).alias("row")))
        giant = self._giants(hard.select("key", "text"))
        plain = docs.where(~flag).select(*names, short(F.col(text_col)).alias(ids_col))
        solved = hard.select("key", "row").join(giant, "key").select(*(F.col("row")[c].alias(c) for c in names), F.col("ids").alias(ids_col))
        return plain.unionByName(solved)

    def _giants(self, texts: DataFrame) -> DataFrame:
        """(key, ids) of the distinct texts of (key, text), each by chunks on many tasks."""
        sent, chunk = self.sent, self.chunk

        def split(batches):
            m = _model(sent.value)
            back = m.longest - 1
            for b in batches:
                for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    s, at = m.prepare(text), [0]
                    while len(s) - at[-1] > chunk + m.longest:  # no chunk is shorter than a piece
                        end = at[-1] + chunk
                        _, last = m.parting(s[max(at[-1] + m.longest, end - REACH) - 1 : end + 1], 1)
                        at.append(end if last < 0 else max(at[-1] + m.longest, end - REACH) - 1 + last)
                    for k, i in enumerate(at):
                        end = at[k + 1] if k + 1 < len(at) else len(s)
                        left = min(i, back)
                        yield pa.RecordBatch.from_pydict({"key": [key], "k": pa.array([k], pa.int32()), "left": pa.array([left], pa.int32()), "ends": [end == len(s)], "body": [s[i - left : end]]})

        @F.arrow_udf("binary")
        def transfer(body: pa.Array, left: pa.Array, ends: pa.Array) -> pa.Array:
            m = _model(sent.value)
            return pa.array([m.matrix(s.as_py(), n.as_py(), e.as_py()).tobytes() for s, n, e in zip(body, left, ends)], pa.binary())

        def unpacked(group: pa.Table) -> tuple[pa.Table, list[np.ndarray]]:
            group, size = group.sort_by("k"), _model(sent.value).longest
            return group, [np.frombuffer(x, np.float64).reshape(size, size) for x in group.column("m").to_pylist()]

        def product(group: pa.Table) -> pa.Table:
            group, ms = unpacked(group)
            return pa.table({"key": group.column("key")[:1], "k": pa.array([group.column("k")[0].as_py() // FAN], pa.int32()), "m": pa.array([reduce(combine, ms).tobytes()], pa.binary())})

        def states(group: pa.Table) -> pa.Table:
            group, ms = unpacked(group)
            found = boundaries(ms, group.column("enter")[0].as_py(), group.column("leave")[0].as_py())
            return pa.table({"key": group.column("key"), "k": group.column("k"), "enter": pa.array(found[:-1], pa.int32()), "leave": pa.array(found[1:], pa.int32())})

        @F.arrow_udf("array<int>")
        def trace(body: pa.Array, left: pa.Array, enter: pa.Array, leave: pa.Array) -> pa.Array:
            rows = zip(*(c.to_pylist() for c in (body, left, enter, leave)))
            return _model(sent.value).columns(pa.array([s[n - i : len(s) - j] for s, n, i, j in rows], pa.string()))

        keyed = texts.dropDuplicates(["key"])
        chunks = cut(keyed.mapInArrow(split, "key string, k int, left int, ends boolean, body string").repartition("key", "k"))
        levels = [cut(chunks.select("key", "k", transfer("body", "left", "ends").alias("m")))]
        most = (chunks.agg(F.max("k")).first()[0] or 0) + 1  # one number
        while most > FAN:
            levels.append(cut(levels[-1].groupBy("key", F.floor(F.col("k") / FAN)).applyInArrow(product, "key string, k int, m binary")))
            most = -(-most // FAN)
        found = levels[-1].select("key", F.floor(F.col("k") / FAN).cast("int").alias("up")).distinct().select("key", "up", F.lit(0).alias("enter"), F.lit(0).alias("leave"))
        for level in levels[::-1]:
            inner = level.withColumn("up", F.floor(F.col("k") / FAN).cast("int")).join(found, ["key", "up"])
            solved = inner.groupBy("key", "up").applyInArrow(states, "key string, k int, enter int, leave int")
            found = solved.select("key", F.col("k").alias("up"), "enter", "leave")
        parts = chunks.join(found.withColumnRenamed("up", "k"), ["key", "k"]).select("key", "k", trace("body", "left", "enter", "leave").alias("part"))
        return parts.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "part"))), lambda x: x["part"])).alias("ids"))

    def decode(self, encoded: DataFrame, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
        """encoded with the text of its ids; a null array gives null, an empty one the empty text."""
        sent = self.sent

        @F.arrow_udf("string")
        def back(ids: pa.Array) -> pa.Array:
            return _model(sent.value).texts(ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids)

        return encoded.withColumn(text_col, back(F.col(ids_col)))
