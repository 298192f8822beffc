"""Token counts from compiled finite-state transducers.

The pre-tokenizer of byte-level BPE files (contractions, optional blank before a run of
letters, numbers or other signs, white space with its look-ahead) is compiled to a
deterministic transducer over character classes. A transition emits a token start at the
character read, at the one before (look-ahead resolved late), at both or at none. A text is
cut into equal lanes; each lane's map from every entry state to its exit state is found for
all lanes at once, the maps are composed by a parallel prefix scan, and with its entry state
known each lane emits.

The merge step is a transducer from pre-token to count. Over unbounded strings that machine is
not finite, so its paths are compiled on demand: one path per distinct pre-token, whose last
transition carries the number of tokens, kept by hash for later batches of the same worker.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm import bpe, kernel as K
from graphloom.llm.bpe import BLANK, CONT, E, L, LETTER, NUMBER, ONE, OTHER, QUOTE, R, SEP, V, WHITE
from graphloom.sources.scratch import drop_columns_clash

#: INIT: the next character starts a token. AP: a lone quote that started one; AP_R.. a quote and
#: that letter. W1, W2: one or more white characters, B when the last is a blank.
INIT, IN_L, IN_N, IN_O, AP, AP_R, AP_V, AP_L, W1_B, W2_B, W1_X, W2_X = range(12)
N_STATES, N_CLASSES = 12, 13
HERE, BEFORE = 1, 2


def compiled() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emission by [state, class]."""
    go = np.zeros((N_STATES, N_CLASSES), np.uint8)
    emit = np.zeros((N_STATES, N_CLASSES), np.uint8)
    for s in range(N_STATES):
        late = BEFORE if s in (AP_R, AP_V, AP_L) else 0
        for c in range(N_CLASSES):
            if c == CONT:
                go[s, c] = s
                continue
            if c == SEP:
                go[s, c], emit[s, c] = INIT, late
                continue
            kind = IN_L if c <= E else IN_N if c == NUMBER else IN_O
            if c in (BLANK, WHITE):
                run = s in (W1_B, W2_B, W1_X, W2_X)
                go[s, c] = (W2_B if run else W1_B) if c == BLANK else (W2_X if run else W1_X)
                emit[s, c] = 0 if run else HERE | late
            elif s == W1_B:
                go[s, c] = kind
            elif s == W2_B:
                go[s, c], emit[s, c] = kind, BEFORE
            elif s in (AP_R, AP_V) and c == E or s == AP_L and c == L:
                go[s, c] = INIT
            elif late:
                go[s, c], emit[s, c] = (IN_L, BEFORE) if kind == IN_L else (AP if c == QUOTE else kind, BEFORE | HERE)
            elif s == AP and c in (ONE, R, V, L):
                go[s, c] = {ONE: INIT, R: AP_R, V: AP_V, L: AP_L}[c]
            elif s == AP and kind == IN_O or s == kind:
                go[s, c] = kind
            else:
                go[s, c] = AP if c == QUOTE else kind
                emit[s, c] = HERE | (BEFORE if s == W2_X else 0)
    return go, emit


GO, EMIT = compiled()


def compose_scan(maps: np.ndarray) -> np.ndarray:
    """Prefix compositions of state maps: row i is the map of lanes 0..i together."""
    d = 1
    while d < len(maps):
        maps = np.concatenate([maps[:d], np.take_along_axis(maps[d:], maps[:-d].astype(np.int64), 1)])
        d *= 2
    return maps


def token_starts(cls: np.ndarray, lane: int = 2048) -> np.ndarray:
    """Places where pre-tokens start."""
    n = len(cls)
    lanes = -(-n // lane)
    grid = np.full(lanes * lane, CONT, np.uint8)
    grid[:n] = cls
    grid = np.ascontiguousarray(grid.reshape(lanes, lane).T)
    go = GO.ravel()
    maps = np.repeat(np.arange(N_STATES, dtype=np.uint8)[None], lanes, 0)
    for row in grid:
        maps = go[maps.astype(np.int32) * N_CLASSES + row[:, None]]
    state = np.full(lanes, INIT, np.uint8)
    state[1:] = compose_scan(maps)[:-1, INIT]
    out = np.empty((lane, lanes), np.uint8)
    emit = EMIT.ravel()
    for j, row in enumerate(grid):
        at = state.astype(np.int32) * N_CLASSES + row
        out[j] = emit[at]
        state = go[at]
    out = out.T.ravel()[:n]
    late = np.flatnonzero(out & BEFORE)
    head = np.maximum.accumulate(np.where(cls != CONT, np.arange(n), 0))
    start = np.zeros(n, bool)
    start[np.flatnonzero(out & HERE)] = True
    start[head[late - 1]] = True
    return np.flatnonzero(start)


class Counter:
    """Counts per text; paths of pre-tokens already compiled stay, ``most`` of them."""

    def __init__(self, path: str, most: int = 1 << 21):
        self.ids, self.table, self.special = bpe.load_json(path)
        self.most = most
        self.known, self.cost = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def compile(self, data, starts, ends, hashes):
        """Costs of distinct pre-tokens."""
        at = np.searchsorted(self.known, hashes)
        at[at == len(self.known)] = 0
        old = self.known[at] == hashes if len(self.known) else np.zeros(len(hashes), bool)
        out = np.empty(len(hashes), np.int64)
        out[old] = self.cost[at[old]]
        new = np.flatnonzero(~old)
        lens = (ends - starts)[new]
        for i in new[lens > 400]:
            out[i] = len(bpe.merge_one(self.ids[data[starts[i] : ends[i]]].tolist(), self.table))
        short = new[lens <= 400]
        lens = lens[lens <= 400]
        for a in range(0, len(short), 100_000):
            s, n = short[a : a + 100_000], lens[a : a + 100_000]
            where = np.repeat(starts[s] - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())
            out[s] = bpe.merge_all(self.ids[data[where]], n, self.table)
        if len(self.known) + len(new) > self.most:
            self.known, self.cost = hashes, out
        elif len(new):
            known = np.concatenate([self.known, hashes[new]])
            order = np.argsort(known, kind="stable")
            self.known, self.cost = known[order], np.concatenate([self.cost, out[new]])[order]
        return out

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        doc = np.repeat(np.arange(n), np.diff(offsets))
        apart = np.zeros(len(data) + n, np.uint8)
        place = np.arange(len(data)) + doc
        apart[place] = data
        cls = np.full(len(apart), SEP, np.uint8)
        cls[place] = bpe.byte_classes(data)
        total = np.zeros(n, np.int64)
        raw = data.tobytes()
        for word in self.special:
            w, at = word.encode(), -1
            while (at := raw.find(w, at + 1)) >= 0:
                d = int(np.searchsorted(offsets, at, "right")) - 1
                if at + len(w) <= offsets[d + 1]:
                    cls[at + d : at + d + len(w)] = SEP
                    total[d] += 1
                    at += len(w) - 1
        starts = token_starts(cls)
        if not len(starts):
            return total
        stop = np.append(np.flatnonzero(cls == SEP), len(cls))
        ends = np.minimum(np.append(starts[1:], len(cls)), stop[np.searchsorted(stop, starts)])
        h = K.word_hashes(apart, starts, ends)
        distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        cost = self.compile(apart, starts[first], ends[first], distinct)[inverse]
        owner = np.searchsorted(offsets[:-1] + np.arange(n), starts, "right") - 1
        return total + np.bincount(owner, cost, n).astype(np.int64)


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """This worker's counter for a file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def _runner(path: str, limit: int):
    def run(batches):
        tool = counter(path)
        for batch in batches:
            data, off = K.packed(batch.column(1))
            for i, j in K.slices(off, 2 << 20):
                n = tool.count(data[off[i] : off[j]], off[i : j + 1] - off[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(off[i : j + 1])), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row, counted as the file's own library does.

    No begin, end or added tokens; a special string inside a text is one token. A null text is
    empty: 0 bytes, 0 tokens. Rows are independent, so equal ids are no matter.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    docs = drop_columns_clash(docs, {id_col: "long", text_col: "string"})
    return docs.mapInArrow(_runner(path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op10(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
