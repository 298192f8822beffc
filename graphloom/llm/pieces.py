"""SentencePiece encoding and decoding by a streaming Viterbi pass.

The lattice has a node for each boundary between characters and an arc for each piece of the
model. In a byte-pair model the score of a path is not a sum: an arc may follow another
exactly when the merge order, applied to the two pieces together, leaves them apart
(``stable``). Each boundary then has one surviving arc. The pass keeps arcs for a window of the
longest piece only and commits ids as soon as the paths from all boundaries of the window
meet in one boundary. Summing piece scores instead, as for unigram models, gives other ids
than the library for byte-pair files, so that is not done here.

No piece crosses a blank that follows another character, so texts are cut there; the units'
ids are kept by their text in a bounded table.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm import kernel as K
from graphloom.sources.scratch import drop_columns_clash

BLANK = "▁"
INF = (float("inf"),)


class Model:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes_of: list[bytes] = []
        self.id_of: dict[str, int] = {}
        self.byte_id = [0] * 256
        self.rank: dict[int, float] = {}
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.bytes_of.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"" if sp.is_control(i) else " ⁇ ".encode())
            else:
                self.id_of[p] = i
                self.rank[i] = -sp.get_score(i)
                self.bytes_of.append(p.replace(BLANK, " ").encode())
        self.longest = max(map(len, self.id_of))
        self.text = {i: p for p, i in self.id_of.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.time: dict[int, tuple] = {}
        self.words = ahocorasick.Automaton()
        for p, i in sorted(self.id_of.items(), key=lambda x: len(x[0])):
            if len(p) == 1:
                self.time[i] = (-1.0, -1.0)
                self.words.add_word(p, (1, i))
                continue
            got = self.merged(p)
            if len(got) == 1:  # others are never the result of merges
                self.words.add_word(p, (len(p), i))
        self.words.make_automaton()
        self.known: dict[tuple[int, int], bool] = {}
        cut = "" if "\n" in self.id_of else "\n"
        self.units = re.compile(f"{BLANK}*[^{BLANK}{cut}]+|{BLANK}+|{cut or '(?!)'}").findall
        self.table = Table(self)

    def merged(self, p: str) -> list[int]:
        """Ids after all merges of one piece's characters; notes the last merge of every part made."""
        sym = [self.id_of.get(c, -1) for c in p]
        while len(sym) > 1:
            best, at, new = float("inf"), -1, -1
            for k in range(len(sym) - 1):
                if sym[k] >= 0 and sym[k + 1] >= 0:
                    i = self.id_of.get(self.text[sym[k]] + self.text[sym[k + 1]])
                    if i is not None and self.rank[i] < best:
                        best, at, new = self.rank[i], k, i
            if at < 0:
                break
            a, b = sym[at], sym[at + 1]
            if len(sym) == 2:
                self.parts[new] = (a, b)
                self.time[new] = max((self.rank[new],) * 2, (self.time[a][0], self.rank[new]), (self.time[b][0], self.rank[new]))
            sym[at : at + 2] = [new]
        return sym

    def stable(self, a: int, b: int) -> bool:
        """Whether merging the text of pieces a and b together gives a, b."""
        key = (a, b)
        got = self.known.get(key)
        if got is None:
            if len(self.known) > 1_000_000:
                self.known.clear()
            got = self.known[key] = self._stable(a, b)
        return got

    def _stable(self, a: int, b: int) -> bool:
        right, left = [a], [b]  # from the piece down to its outermost character
        while right[-1] in self.parts:
            right.append(self.parts[right[-1]][1])
        while left[-1] in self.parts:
            left.append(self.parts[left[-1]][0])
        x, y = len(right) - 1, len(left) - 1
        while True:
            i = self.id_of.get(self.text[right[x]] + self.text[left[y]])
            cross = INF if i is None else (max(self.rank[i], self.time[right[x]][0], self.time[left[y]][0]), self.rank[i], 1)
            up = (*self.time[right[x - 1]], 0) if x else INF
            down = (*self.time[left[y - 1]], 2) if y else INF
            first = min(cross, up, down)
            if first is INF or first == INF:
                return True
            if first == cross:
                return False
            if first == up:
                x -= 1
            else:
                y -= 1

    def encode_short(self, unit: str) -> list[int]:
        """The pass over a unit that fits the window: all paths meet at its end."""
        n = len(unit)
        start, ids, known = list(range(-1, n)), [-1] * (n + 1), self.known
        for end, (size, i) in self.words.iter(unit):
            end += 1
            if ids[end] < 0:
                before = ids[end - size]
                if before < 0:
                    ok = True
                else:
                    ok = known.get((before, i))
                    if ok is None:
                        ok = self.stable(before, i)
                if ok:
                    start[end], ids[end] = end - size, i
        out, at = [], n
        while at:
            if ids[at] >= 0:
                out.append(ids[at])
            else:
                out.extend(self.byte_id[c] for c in reversed(unit[at - 1].encode()))
            at = start[at]
        out.reverse()
        return out

    def encode_unit(self, unit: str) -> list[int]:
        """Streaming pass over one unit of any length."""
        if len(unit) <= 4 * self.longest:
            return self.encode_short(unit)
        n, out = len(unit), []
        done = 0  # boundary up to which ids are committed
        ends = iter(self.words.iter(unit))
        held = next(ends, None)
        last: dict[int, tuple[int, int]] = {}  # boundary -> (where its arc starts, id); -1: a character without piece
        for j in range(1, n + 1):
            found = None
            while held is not None and held[0] == j - 1:
                size, i = held[1]
                if found is None and j - size >= done:
                    before = last.get(j - size)
                    if before is None or before[1] < 0 or self.stable(before[1], i):
                        found = (j - size, i)
                held = next(ends, None)
            last[j] = found or (j - 1, -1)
            if j - done > 4 * self.longest and j % self.longest == 0 or j == n:
                # paths back from every boundary of the window, or from the end
                front = {j} if j == n else set(range(j - self.longest + 1, j + 1))
                while len(front) > 1:
                    top = max(front)
                    front.discard(top)
                    front.add(last[top][0] if top > done else done)
                meet, path = front.pop(), []
                at = meet
                while at > done:
                    path.append(last[at])
                    at = last[at][0]
                for s, i in reversed(path):
                    if i >= 0:
                        out.append(i)
                    else:
                        out.extend(self.byte_id[c] for c in unit[s].encode())
                keep = last.get(meet)
                last = {k: v for k, v in last.items() if k > meet}
                if keep is not None:
                    last[meet] = keep
                done = meet
        return out

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        return np.frombuffer(b"".join(map(self.table.__getitem__, self.units(BLANK + text.replace(" ", BLANK)))), np.int32)

    def decode(self, ids) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode(errors="replace")


class Table(dict):
    """Ids of units as bytes, in two generations of ``most`` units each."""

    def __init__(self, model: Model, most: int = 300_000):
        self.model, self.most, self.old = model, most, {}

    def __missing__(self, unit):
        got = self.old.get(unit)
        if got is None:
            got = np.array(self.model.encode_unit(unit), np.int32).tobytes()
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        if len(unit) < 256:
            self[unit] = got
        return got


@lru_cache
def model(path: str) -> Model:
    return Model(path)


def _coder(path: str):
    def run(batches):
        m = model(path)
        for batch in batches:
            _, off = K.packed(batch.column(1))
            for i, j in K.slices(off, 2 << 20):
                made, exact = [], []
                for t in batch.column(1).slice(i, j - i).to_pylist():
                    t = t or ""
                    made.append(m.encode(t))
                    exact.append(m.decode(made[-1].tolist()) == t)
                n = np.array([len(x) for x in made])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), K.scattered(np.concatenate(made), n), pa.array(exact)], names=["doc_id", "n_pieces", "ids", "exact"])

    return run


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_pieces, ids, exact`` for every row: the library's ids without begin or end, and whether decoding them gives the text back.

    A null text is empty and has no ids. ``exact`` is false where the text holds U+2581 itself,
    which decodes to a blank. Rows are independent.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    docs = drop_columns_clash(docs, {id_col: "long", text_col: "string"})
    return docs.mapInArrow(_coder(path), "doc_id long, n_pieces long, ids array<int>, exact boolean")


def op9(spark, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
