"""Each operator on one small table with every awkward row, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, copies int, Gone string"
rng = random.Random(7)
WORDS = ["alpha", "beta", "gamma", "the", "of", "and", "delta", "Été", "漢字", "x1", "it's", "zeta***"]


def prose(n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", str(rng.randrange(99))]) for _ in range(n))


BASE = prose(120)
ROWS = [
    (1, BASE, "en", "a", 0), (2, BASE, "en", "a", 0), (3, BASE + " tail", None, "a", 0), (4, BASE[:300] + "\n" + prose(60), "en", None, 0),
    (5, "", "en", "b", 0), (6, None, "en", "b", None), (7, "one two three", "en", "a", 13), (8, "one  TWO\tthree", "en", "a", 13), (9, " \n\t ", "en", "c", 5),
    (10, "line one of some length here\nline one of some lengtH here\nother line that is quite long", "de", "a", 0), (11, "line one of some length here\nshort", "de", "a", 0),
    (None, BASE, "en", "a", 0), (20, prose(3000), "en", "a", 0), (40, "<|endoftext|> it's " + prose(9), "en", "a", 0), (40, "<|endoftext|> it's again", "en", "a", 0), (1, BASE, "en", "a", 0),
]
ROWS = [(*r, 0.5, 1, "g") for r in ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t):
    w = tokens(lower(t))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_near_duplicates(docs, nothing):
    from graphloom.llm.minhash import near_duplicates

    got = near_duplicates(docs).collect()
    sets = [(r[0], shingles(r[1])) for r in ROWS]
    comp = {i: i for i, _ in sets if i is not None}
    for _ in comp:
        for i, a in sets:
            for j, b in sets:
                if None not in (i, j) and a and b and 100 * len(a & b) >= 85 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter((i, len(s), comp.get(i)) for i, s in sets)
    assert near_duplicates(nothing).count() == 0


def test_near_duplicates_in_a_group_that_no_hub_joins(spark):
    """A chain of texts, each near the next one only."""
    from graphloom.llm.minhash import near_duplicates

    w = [f"w{i}" for i in range(400)]
    rows = [(100 - k, " ".join(w[k * 8 : k * 8 + 200])) for k in range(12)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=4).collect()
    assert {r.component_id for r in got} == {89}


def test_substrings(docs, nothing):
    from graphloom.llm.substring import substring_dedup

    first = {}
    for i, t, *_ in ROWS:
        w = tokens(t)
        for k in range(len(w) - 12):
            if i is not None:
                key = tuple(w[k : k + 13])
                first[key] = min(first.get(key, i), i)
    want = Counter()
    for i, t, *_ in ROWS:
        w = tokens(t)
        gone = {k + d for k in range(len(w) - 12) if i is not None and first[tuple(w[k : k + 13])] < i for d in range(13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[(i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    got = substring_dedup(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert substring_dedup(nothing).count() == 0


def test_token_counts_equal_the_library(docs, nothing):
    import public_tokenizers
    from graphloom.llm.token_counts import count_tokens
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in count_tokens(docs).collect())
    assert got == Counter((r[0], len((r[1] or "").encode()), len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in ROWS)
    assert count_tokens(nothing).count() == 0


def test_pre_tokens_on_random_strings():
    import public_tokenizers
    import pyarrow as pa
    from graphloom.llm import kernel as K
    from graphloom.llm.token_counts import Counter as Tool
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, tool = Tokenizer.from_file(path), Tool(path)
    texts = ["".join(rng.choice("abstmdrvle' '  \n\t1é漢!") for _ in range(rng.randrange(50))) for _ in range(400)] + ["a" * 3000, " " * 3000]
    assert tool.count(*K.packed(pa.array(texts))).tolist() == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


def test_pieces_equal_the_library_and_round_trip(docs, nothing):
    import public_tokenizers
    import sentencepiece
    from graphloom.llm.pieces import encode_documents, model

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = encode_documents(docs).collect()
    assert all(r.exact and r.n_pieces == len(r.ids) for r in got)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter((r[0], tuple(sp.encode(r[1] or ""))) for r in ROWS)
    m = model(path)
    for text in [r[1] or "" for r in ROWS] + ["ab" * 4000, "   \n\n  x", "🙂" * 200, "".join(rng.choice("ERth ing.,12 ") for _ in range(3000))]:
        assert m.encode(text).tolist() == sp.encode(text) and m.decode(sp.encode(text)) == text
    assert encode_documents(nothing).count() == 0


def test_line_dedup(docs, nothing):
    from graphloom.llm.line_dedup import dedup_lines, without_repeated_lines

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        a, b = sorted((a, b), key=len, reverse=True)
        return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))

    def match(a, b):
        return bool(re.search(r"[^\x20\x09-\x0D]", b)) and (a == b or min(len(a), len(b)) >= 20 and near(a, b))

    places = sorted({(r[0] if r[0] is not None else 2**63, t, k, x) for r in ROWS for t in [r[1]] if t is not None for k, x in enumerate(t.split("\n"))}, key=lambda p: (p[0], p[2]))
    want = Counter()
    for i, t, *_ in ROWS:
        if t is None:
            want[(i, None)] += 1
            continue
        at = i if i is not None else 2**63
        out = [x for k, x in enumerate(t.split("\n")) if not any((p[0], p[2]) < (at, k) and match(p[3], x) for p in places)]
        want[(i, "\n".join(out))] += 1
    assert Counter((r.doc_id, r.text) for r in dedup_lines(docs).collect()) == want
    assert dedup_lines(nothing).count() == 0 and without_repeated_lines(docs).columns == docs.columns
    with pytest.raises(ValueError):
        dedup_lines(docs, edits=2)


def test_mixture(docs, nothing, spark):
    from graphloom.llm.mixture import mix_sources

    big = spark.range(4000).selectExpr("id doc_id", "if(id % 4 = 0, 'x', 'y') source")
    got = mix_sources(big, {"x": 3.0, "y": 1.0}, total=8000.0).groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in got}
    assert abs(n["x"] - 6000) < 5 * math.sqrt(6000) and abs(n["y"] - 2000) < 5 * math.sqrt(2000)
    one = spark.createDataFrame([(5, "x")], "doc_id long, source string")
    m = mix_sources(one, {"x": 1.0}, total=500.0).count()
    assert abs(m - 500) < 5 * math.sqrt(500)
    out = mix_sources(docs, total=200.0)
    assert {"copy", "copies", "order_key", "Gone"} <= set(out.columns) and "score" in out.columns
    rates, drawn = {}, Counter()
    for r in ROWS:
        rates[r[3]] = rates.get(r[3], 0) + 1
    for i, t, lang, source, *_ in ROWS:  # by brute force: equal ids draw equally, a null id as the empty one
        m = 200 / len(rates) / rates[source]
        draws = max(1, math.ceil(m / 32))
        for d in range(draws):
            u = int(hashlib.md5(f"20:{'' if i is None else i}:{d}".encode()).hexdigest()[:13], 16) / 2**52
            p = c = math.exp(-m / draws)
            k = 0
            while c <= u and k < 128:
                k += 1
                p *= m / draws / k
                c += p
            drawn[(i, t, source)] += k
    assert Counter((r.doc_id, r.text, r.source) for r in out.collect()) == +drawn
    assert mix_sources(nothing).count() == 0


def test_quality(docs, nothing, spark):
    from graphloom.llm.quality import score_documents

    rows = [(i, prose(40) if i % 3 else " ".join(w + "***" for w in prose(40).split())) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = score_documents(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    held = [r for r in got if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) / len(held) > 0.95
    assert score_documents(docs, labels).count() == len(ROWS) and score_documents(nothing, labels).count() == 0
    assert {r.predicted for r in score_documents(docs, labels.limit(0)).collect()} == {0}


def test_language_model(docs, nothing, spark):
    from graphloom.llm.mixing_lm import score_texts

    toks = lambda t: [*tokens(lower(t)), None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(x for r in ROWS if not held(r[0]) for x in toks(r[1]))
    n, v = sum(c.values()), len(c)
    want = Counter((r[0], len(toks(r[1])), sum(c[x] > 0 for x in toks(r[1])), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in toks(r[1])), 6), held(r[0])) for r in ROWS)
    got = score_texts(docs).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), r.held_out) for r in got) == want
    assert all(r.score < 0 for r in got) and score_texts(nothing).count() == 0


def test_costs_are_a_distribution():
    """Over all first bytes of a token the probabilities of the coded bits sum to one."""
    from graphloom.llm import mixing_lm as M

    counts = [np.random.default_rng(k).integers(0, 90, 2 << s).astype(np.uint8) for k, s in enumerate(M.SLOTS)]
    m = M.Mixer(counts, apm=np.ones((2, M.GATES, M.BINS)))
    total = 0.0
    for byte in range(256):
        data = np.array([byte, 10], np.uint8)
        token, got, place, ctx = M.coded(data, np.array([0]), np.array([1]))
        bits = 0.0
        for b in range(8):
            slots, bit = M.bit_slots([c[:1] for c in ctx], got[:1], b)
            xs, gate = m.evidence(slots, place[:1])
            p = 1 / (1 + np.exp(-m.mixed(xs, gate)))
            bins = np.clip(np.rint(m.mixed(xs, gate) * 1.25) + M.BINS // 2, 0, M.BINS - 1).astype(int)
            p = (p + (m.apm[1][gate, bins] + p) / (m.apm[0][gate, bins] + 1)) / 2
            bits -= math.log2(p[0] if bit[0] else 1 - p[0])
        total += 2**-bits
    assert abs(total - 1) < 1e-6


def test_spotsigs(docs, nothing):
    from graphloom.llm.spotsigs import fingerprint, near_sets, with_next

    rows = sorted(((r[0], r[1] or "") for r in ROWS), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    texts = [t for _, t in rows]
    want = Counter((i, t, texts[(k + 1) % len(texts)]) for k, (i, t) in enumerate(rows))
    plain = docs.selectExpr("doc_id", "coalesce(text, '') text")
    assert Counter(tuple(r) for r in with_next(plain, parts=3).collect()) == want
    far = docs.sparkSession.createDataFrame([(2**63 - 1, "x"), (-(2**63), "y"), (0, "z")], "doc_id long, text string")
    assert {(r.text, r.next_text) for r in with_next(far).collect()} == {("x", "z"), ("z", "y"), ("y", "x")}
    sig = {(r.doc_id, r.n_chars): tuple(r.sig) for r in fingerprint(docs).collect()}
    assert sig[(1, len(BASE))] == sig[(2, len(BASE))] and sig[(5, 0)] == sig[(6, 0)]
    base = [rng.sample(range(1000), rng.randrange(3, 40)) for _ in range(6)]
    sets = {i: frozenset(x for x in b if rng.random() > 0.08) | frozenset(rng.sample(range(1000), rng.randrange(3))) for i in range(40) for b in [base[i % 6]]}
    first = {}
    for i, x in sets.items():
        first.setdefault(x, i)
    want = {(i, j) for x, i in first.items() for y, j in first.items() if i < j and x and y and len(x & y) >= 0.8 * len(x | y)}
    made = docs.sparkSession.createDataFrame([(i, sorted(x)) for i, x in sets.items()], "doc_id long, sig array<int>")
    assert want and {(r.a, r.b) for r in near_sets(made).collect()} == want
    assert with_next(plain.limit(0)).count() == 0 and fingerprint(nothing).count() == 0


def chroma_brute(rows, every=20):
    """Every query against every other recording, over all keys they share."""
    from graphloom.llm import chroma as C

    def keys(a, b):
        k = [(int(x) << 32) | int(b[min(i + C.GAP, len(b) - 1)]) for i, x in enumerate(a)]
        return [(x, i) for i, x in enumerate(k) if i == 0 or x != k[i - 1]]

    made = {i: np.frombuffer(x, np.uint8) for i, x in rows}
    codes = {i: C.fingerprint(x, 2000) for i, x in made.items()}
    out = {}
    for q in (i for i in made if i % every == 0 and len(made[i])):
        phases = C.phases_of(made[q], 2000)
        asked = [(k, at * C.HOP + p * C.HOP // C.PHASES) for p, (c, t) in enumerate(phases) for a in (c, t) for b in (c, t) for k, at in keys(a, b)]
        for r in made:
            if r == q or not len(made[r]):
                continue
            where = {}
            for key, k in keys(codes[r], codes[r]):
                where.setdefault(key, []).append(k)
            votes = Counter(k * C.HOP - place for key, place in asked for k in where.get(key, ()))
            if not votes:
                continue
            off, n = max(votes.items(), key=lambda v: (v[1], -abs(v[0]), v[0]))
            phase = -off % C.HOP
            x, shift = phases[phase * C.PHASES // C.HOP][0], (off + phase) // C.HOP
            both = [(int(x[i]), int(codes[r][i + shift])) for i in range(len(x)) if 0 <= i + shift < len(codes[r])]
            if both:
                out[(q, r)] = (off, n, round(sum(bin(a ^ b).count("1") for a, b in both) / 32 / len(both), 9))
    return out


def test_alignments_against_brute_force(spark):
    from graphloom.llm import chroma as C

    texts = [prose(60 + 20 * k).encode() for k in range(12)]
    rows = [(20 * k, t) for k, t in enumerate(texts)] + [(20 * k + 1, t[137 + 9 * k :] if k % 2 else t[: len(t) // 2] + b"other words " + t[len(t) // 2 :]) for k, t in enumerate(texts)]
    made = C.fingerprints(spark.createDataFrame(rows, "rec long, pcm binary"), "rec", "pcm", every=20).cache()
    got = C.alignments(made.select("rec", "codes"), made.where("phases is not null").select(F.col("rec").alias("q"), "phases"), 1.0).collect()
    want = chroma_brute(rows)
    assert {(g.q, g.r): (g.offset, g.votes, round(g.errors, 9)) for g in got} == want and len(want) >= 8


def test_alignments_of_keys_with_many_places(spark, monkeypatch):
    """Sixty recordings share one passage, some of them several times: every one is compared, in rows, in blocks and in parts of votes."""
    from graphloom.llm import chroma as C

    passage, r = prose(90).encode(), np.random.default_rng(5)
    rows = [(i, prose(30).encode() * (i % 7 == 0) + passage * (1 + i % 3) + prose(int(r.integers(2, 60))).encode()) for i in range(60)]
    rows += [(100 + i, prose(80).encode()) for i in range(3)] + [(103, rows[1][1])]
    want = chroma_brute(rows)
    assert min(sum(q == i for q, _ in want) for i in (0, 20, 40)) >= 59
    made = C.fingerprints(spark.createDataFrame(rows, "rec long, pcm binary"), "rec", "pcm", every=20).cache()
    codes, queries = made.select("rec", "codes"), made.where("phases is not null").select(F.col("rec").alias("q"), "phases")
    got = C.alignments(codes, queries, 1.0).collect()
    assert {(g.q, g.r): (g.offset, g.votes, round(g.errors, 9)) for g in got} == want and len(got) == len(want)
    found = {x.doc_id: x for x in C.search_recordings(made.sparkSession.createDataFrame(rows, "rec long, pcm binary"), "rec", "pcm").collect()}
    for q in (0, 20, 40):
        near = {r: v for (i, r), v in want.items() if i == q and v[2] <= 0.3}
        assert len(near) > 10 and found[q].n_aligned == len(near) and round(found[q].best_errors, 9) == min(v[2] for v in near.values())
        assert all(found[r].class_id == found[q].class_id for r in near)
    # votes of one query in several parts
    monkeypatch.setattr(C, "VOTES", 50)
    phases = [(q, C.phases_of(np.frombuffer(dict(rows)[q], np.uint8), 2000)) for q in (0, 20, 40, 100)]
    each = [C.fingerprint(np.frombuffer(t, np.uint8), 2000) for _, t in rows]
    block = C._Recordings(np.array([i for i, _ in rows]), np.ones(len(rows), np.int64), np.array([len(x) for x in each]), np.concatenate(each))
    sizes, code, turned = np.array([len(c) for _, p in phases for c, _ in p]), np.concatenate([c for _, p in phases for c, _ in p]), np.concatenate([t for _, p in phases for _, t in p])
    out = {}
    for q, rec, offset, votes in block.votes(sizes, code, turned):
        errors = block.errors(q, rec, offset, sizes, code)
        out |= {(phases[a][0], rows[b][0]): (int(o), int(v), round(float(e), 9)) for a, b, o, v, e in zip(q, rec, offset, votes, errors) if phases[a][0] != rows[b][0]}
    assert out == want


def test_forest_joins_what_edges_join():
    from graphloom.llm.chroma import _forest

    for u, v, n in (([5, 5, 9], [7, 9, 5], 2), (list(range(200)), list(range(1, 201)), 200), ([1, 3], [2, 4], 2)):
        a, b = _forest(np.array(u), np.array(v))
        assert len(a) == n

        def parts(edges):
            of = {}
            for x, y in edges:
                both = of.get(x, {x}) | of.get(y, {y})
                for z in both:
                    of[z] = both
            return {frozenset(p) for p in of.values()}

        assert parts(zip(u, v)) == parts(zip(a.tolist(), b.tolist()))


def test_chroma(spark, nothing):
    from graphloom.llm.chroma import fingerprint, search_recordings

    r = np.random.default_rng(0)
    notes = np.repeat(r.integers(0, 24, 80), 500)
    tune = (128 + 60 * np.sin(2 * np.pi * 110 * 2 ** (notes / 12) * np.arange(len(notes)) / 2000)).astype(np.uint8)
    noisy = np.clip(tune.astype(int) + r.integers(-8, 9, len(tune)), 0, 255).astype(np.uint8)[128 * 20 :]
    other = r.integers(0, 256, 30000).astype(np.uint8)
    rows = [(20, tune.tobytes()), (21, noisy.tobytes()), (22, other.tobytes()), (23, tune.tobytes()), (24, None), (25, b""), (None, b"abc"), (40, b"x"), (60, b""), (80, other.tobytes()), (80, other.tobytes())]
    got = {x.doc_id: x for x in search_recordings(spark.createDataFrame(rows, "doc_id long, pcm binary"), "doc_id", "pcm").collect()}
    assert len(got) == len({i for i, _ in rows}) and got[20].n_aligned == 2 and got[20].class_id == got[21].class_id == got[23].class_id == 20
    assert got[24].n_codes == got[25].n_codes == got[60].n_codes == 0 and got[22].n_aligned is None and got[40].n_aligned == 0 and got[60].class_id is None
    assert got[80].n_aligned == 1 and got[80].best_id == 22 and got[22].class_id == got[80].class_id == 22
    a, b = fingerprint(tune, 2000)[80:], fingerprint(noisy, 2000)
    assert np.mean([bin(int(p ^ q)).count("1") for p, q in zip(a, b)]) / 32 < 0.1
    assert search_recordings(nothing.selectExpr("doc_id", "cast(text as binary) pcm"), "doc_id", "pcm").count() == 0


def test_recall_of_the_search(spark):
    """Recordings cut at any sample, with a word changed, or with noise of two steps: nine in ten or more are found."""
    from graphloom.llm.chroma import search_recordings

    r = np.random.default_rng(3)
    rows, pairs = [], {"cut": [], "word": [], "noise": []}
    for k in range(90):
        t = " ".join("".join(chr(97 + c) for c in r.integers(0, 26, r.integers(2, 9))) for _ in range(120 + k)).encode()
        w = t.split(b" ")
        w[int(r.integers(len(w)))] = b"changed"
        kind, other = (("cut", t[int(r.integers(5, 200)) :]), ("word", b" ".join(w)), ("noise", np.clip(np.frombuffer(t, np.uint8).astype(int) + r.integers(-2, 3, len(t)), 0, 255).astype(np.uint8).tobytes()))[k % 3]
        rows += [(20 * k, t), (20 * k + 1, other)]
        pairs[kind].append(20 * k)
    got = {x.doc_id: x for x in search_recordings(spark.createDataFrame(rows, "doc_id long, pcm binary"), "doc_id", "pcm").collect()}
    for kind, ids in pairs.items():
        assert sum(got[i].class_id == got[i + 1].class_id == i for i in ids) >= 0.9 * len(ids), kind


def test_pair_counts_and_their_gates(docs):
    """Counts of pairs by brute force; probabilities over all tokens after one sum to at most one."""
    from graphloom.llm import kernel as K, mixing_lm as M
    import pyarrow as pa

    assert np.all(np.diff(M.STEPS) > 0) and list(M.STEPS[:9]) == list(range(9)) and len(M.STEPS) == 256
    data, off = K.packed(pa.array([r[1] for r in ROWS]))
    text, starts, ends, first = M.tokens(data, off)
    keys = M.pair_keys(K.word_hashes(text, starts, ends), first)
    want = Counter(p for r in ROWS for w in [[None, *tokens(lower(r[1])), None]] for p in zip(w, w[1:]))
    assert sorted(Counter(keys.tolist()).values()) == sorted(want.values())
    load = np.arange(len(keys)) % 3
    got = M.STEPS[M._stepped(keys, load)]
    total = Counter()
    for k, n in zip(keys.tolist(), load.tolist()):
        total[k] += n
    assert all(0 <= total[k] - g <= 0.13 * total[k] for k, g in zip(keys.tolist(), got))
    cells = np.zeros((M.SEEN, M.GAINS))
    cells[3, 0], cells[3, 60], cells[5, 0] = 40, 60, 10
    g = M.trusted(cells.ravel())
    assert g[0] == 0 and 0.55 < g[3] < 0.65 and g[5] < 0.01 and g[7] == 0


def test_the_token_before_helps(spark):
    """Fixed phrases in a random order: held-out texts score better than by words alone."""
    from graphloom.llm.mixing_lm import score_texts

    phrases = [prose(6) for _ in range(30)]
    rows = [(i, " ".join(rng.choice(phrases) for _ in range(12))) for i in range(250)]
    got = [r for r in score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.held_out]
    assert got and all(r.base_score < r.score < 0 for r in got)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    d = spark.createDataFrame([(i, prose(50), "en", f"s{i % 3}", 1) for i in range(60)] + [(100 + i, BASE, "en", "s0", 1) for i in range(5)], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    x = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        x = stage(spark, x, str(tmp_path))
        assert x.columns == d.columns
        if name == "near_duplicates":
            assert {r.doc_id for r in x.collect()} == set(range(60)) | {100}
    assert corpus_pipeline.run(spark, str(tmp_path)).where("exact").count() > 20


def test_pipeline_drops_documents_of_a_similarity_between_80_and_85(spark):
    import corpus_pipeline

    rows = []
    for k in range(10):
        w = [f"w{k}x{i}" for i in range(100)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join("other" if i in (30, 60) else x for i, x in enumerate(w)))]
    a, b = shingles(rows[0][1]), shingles(rows[1][1])
    assert 0.8 <= len(a & b) / len(a | b) < 0.85
    got = corpus_pipeline.dedup_documents(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in got.collect()) == list(range(0, 20, 2))


def test_pipeline_drops_copies_of_short_lines(spark):
    import corpus_pipeline

    rows = [(1, "Ietzte.\n\nIetzte.\nx\n  \n\nIetzten.", 30), (2, "x\n  \nIetzte.\nnew", 18), (3, "x\nIetzten.", 10), (4, "a line of some length here", 26), (5, "a line of some lengtH here\n{", 28)]
    got = corpus_pipeline.dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), "")
    assert {tuple(r) for r in got.collect()} == {(1, "Ietzte.\n\nx\n  \n\nIetzten.", 23), (2, "  \nnew", 6), (4, rows[3][1], 26), (5, "{", 1)}


def test_recordings_of_the_length_of_texts_have_several_codes():
    from graphloom.llm.chroma import fingerprint

    text = np.frombuffer(prose(400).encode()[:1500], np.uint8)
    assert len(fingerprint(text, 2000)) == 38


def test_closest_recording_is_another_one(spark):
    from graphloom.llm.chroma import search_recordings

    text = prose(200).encode()
    rows = [(20, text), (40, text), (41, text), (60, prose(200).encode())]
    got = {x.doc_id: x for x in search_recordings(spark.createDataFrame(rows, "doc_id long, pcm binary"), "doc_id", "pcm").collect()}
    assert [got[i].best_id for i in (20, 40, 41)] == [40, 20, None] and got[60].best_id != 60
    assert [got[i].n_aligned for i in (20, 40)] == [2, 2] and got[20].class_id == 20


def test_slot_counts_beyond_32_bits(spark):
    """The slots of the first byte count three chunks' tokens of 2^31 and 39 others, summed over tasks."""
    from graphloom.llm import mixing_lm as M

    counts = np.array([1 << 31] + [1] * 39, np.uint32)
    words = "".join(f"a{i:02}\n" for i in range(40)).encode()
    rows = [(0, c, bytearray(zlib.compress(counts.tobytes())), bytearray(zlib.compress(words))) for c in range(3)]
    blobs = spark.createDataFrame(rows, M.BLOB).repartition(3, "chunk")
    parts = M.summed_by_tree(blobs.mapInArrow(M._counter, M.COUNTED), fan=2)
    want = 3 * ((1 << 31) + 39)
    assert sum(r["n"] for r in parts) == want and len(parts) == M.P * M.PARTS
    for k in range(M.P):
        total = np.concatenate([np.frombuffer(zlib.decompress(r["part"]), np.uint8) for r in sorted((r for r in parts if r["k"] == k), key=lambda r: r["p"])])
        assert M.levels(np.array([want]))[0] in total or k == M.WHOLE
    big = np.array([0, 1, 5, 1 << 16, 3 << 20, 1 << 40, 1 << 47], float)
    assert np.all(np.abs(M.LEVELS[M.levels(big)] - big) <= 0.1 * big + 1e-9)


def test_shared_beginnings_of_tokens_cost_once(monkeypatch):
    """Tokens of one long beginning: bits are looked up once for each distinct beginning, and costs and counts are those of each token alone."""
    from graphloom.llm import mixing_lm as M
    import pyarrow as pa

    tokens = [b"a" * 40 + b"%02d" % i for i in range(60)] + [b"x", b"aa"]
    bounds = np.cumsum([0] + [len(t) + 1 for t in tokens])
    data, starts, ends = np.frombuffer(b"\n".join(tokens) + b"\n", np.uint8), bounds[:-1], bounds[1:] - 1
    count = np.arange(len(tokens)).astype(np.uint64)
    looked, inner = [], M.bit_slots
    monkeypatch.setattr(M, "bit_slots", lambda ctx, byte, *x: looked.append(len(byte)) or inner(ctx, byte, *x))
    distinct = len({(t + b" ")[: i + 1] for t in tokens for i in range(len(t) + 1)})
    levels = [np.random.default_rng(k).integers(0, 90, 2 << s).astype(np.uint8) for k, s in enumerate(M.SLOTS)]
    m = M.Mixer(levels, apm=np.ones((2, M.GATES, M.BINS)))
    got = m.costs(data, starts, ends)
    assert sum(looked) <= 8 * distinct
    alone = [m.costs(data, starts[i : i + 1], ends[i : i + 1])[0] for i in range(len(tokens))]
    assert np.allclose(got, alone, rtol=1e-12)

    looked.clear()
    rows = [(0, 0, zlib.compress(count.astype(np.uint32).tobytes()), zlib.compress(data.tobytes())), (1, 0, zlib.compress(np.zeros(1, np.uint32).tobytes()), zlib.compress(b"held\n"))]
    blob = pa.RecordBatch.from_pylist([dict(zip(("bucket", "chunk", "counts", "words"), r)) for r in rows])
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    sums = {k: [] for k in range(M.P)}
    for r in M._counter([blob]):
        sums[r["k"][0].as_py()].append(np.frombuffer(zlib.decompress(r["part"][0].as_py()), np.uint64))
    assert sum(looked) <= 8 * M.P * distinct
    token, byte, _, ctx = M.coded(data, starts, ends)
    for k in range(M.P):
        want = np.zeros(2 << M.SLOTS[k], np.uint64)
        for b in range(8):
            slots, bit = inner([ctx[k]], byte, b, (k,))
            np.add.at(want, slots[0] * 2 + bit, np.where((count > 1) | (k != M.WHOLE), count, 0).astype(np.uint64)[token])
        assert np.array_equal(np.concatenate(sums[k]), want), k


def test_language_model_does_not_depend_on_partitions(spark):
    from graphloom.llm import mixing_lm as M

    rows = [(i, prose(30 + i % 90)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    group, M.GROUP = M.GROUP, 64  # several groups
    try:
        for n in (2, 16):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append({r.doc_id: (r.score, r.base_score) for r in M.score_texts(docs).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        M.GROUP = group
    assert got[0].keys() == got[1].keys() and all(abs(a - b) < 1e-6 for i in got[0] for a, b in zip(got[0][i], got[1][i]))


def test_spotsigs_query_against_brute_force(docs, spark, tmp_path):
    """``op2`` over all awkward rows: spots, edited texts and likenesses written anew in Python."""
    from graphloom.llm.spotsigs import ANCHORS, op2

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(((r[0], r[1] or "") for r in ROWS), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))

    def spots(t):
        words = [w for w in re.split(r"[\W_]+", t.lower()) if w]
        content = [(k, w) for k, w in enumerate(words) if w not in ANCHORS]
        # heads: the start or a run of anchors, with the content word that follows it
        heads, k = [], 0
        while k <= len(words):
            run = []
            while k < len(words) and words[k] in ANCHORS:
                run.append(words[k])
                k += 1
            if run or not heads:
                heads.append((("^", *run) if not heads else tuple(run), k))
            k += 1
        out = set()
        for run, k in heads:
            first = words[k] if k < len(words) else ""
            later = [w for j, w in content if j > k]
            out.add((run, first, later[0] if later else ""))
        return out

    want = Counter()
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        a, b, c = spots(t), spots(edited), spots(nxt)
        want[(i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(len(a & b) / len(a | b), 6), round(len(a & c) / len(a | c), 6))] += 1
    got = op2(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 6), round(r.near_next, 6)) for r in got) == want
    assert all((r.fingerprint == s.fingerprint) for r in got for s in got if r.n_chars == s.n_chars and r.doc_id in (1, 2) and s.doc_id in (1, 2))


def test_spots_cut_a_text_once(spark):
    """A text is lower-cased and cut by one pattern only, and chains of any length are those of a loop over its words."""
    from graphloom.llm.spotsigs import ANCHORS, MARK, spots

    texts = ["", "the", "of the", "alpha", "The quick, fox of THE alpha", "alpha the", "a b the c", " x  the\u0001of y z\n", "\u0130stanbul in \u6f22\u5b57 und Stra\u00dfe", *(prose(n) for n in (5, 40))]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    plan = docs.select(spots(F.col("text")).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1 and plan.count("lower(") == 1

    def heads(text, chain):
        words = [w for w in re.split(r"[^\w]|_", text.lower().replace("\u0307", " ")) if w]
        out, run, content = [], "^" + MARK, []
        for w in words:
            if w in ANCHORS:
                run += w + MARK
            else:
                out.append((run + w, len(content) + 1))
                content.append(w)
                run = ""
        out.append((run, len(content) + 1))
        return {" ".join([h, *((content + [""] * (k + chain))[k : k + chain - 1])]) for h, k in out if MARK in h}

    for chain in (1, 2, 3):
        got = docs.select("text", spots(F.col("text"), chain).alias("s")).collect()
        names = sorted({h for t in texts for h in heads(t, chain)})
        hashed = {r.h: r.x for r in spark.createDataFrame([(h,) for h in names], "h string").select("h", F.hash("h").alias("x")).collect()}
        assert [r.s for r in got] == [sorted({hashed[h] for h in heads(r.text, chain)}) for r in got]


def test_stages_of_the_pipeline_take_any_table(docs, nothing, spark, tmp_path):
    """Clashing columns, nulls, empty, long and repeated texts, and no rows: each stage keeps the columns and the rows it should."""
    import corpus_pipeline

    spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    extra = docs.withColumn("_gone", F.lit(1)).withColumn("_id", F.lit(2)).withColumn("b", F.lit("x"))
    clash = extra.toDF(*[{"b": "TEXT"}.get(c, c) for c in extra.columns])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, clash, str(tmp_path))
        rows = out.collect()
        if name == "encode":
            assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in ROWS)
        else:
            assert out.columns == clash.columns
            empty = nothing.withColumn("_gone", F.lit(1))
            assert stage(spark, empty, str(tmp_path)).count() == 0
        if name == "near_duplicates":
            assert Counter(r[0] for r in rows)[2] == 0 and Counter(r[0] for r in rows)[None] == 1


def test_pipeline_run_against_its_stages_by_brute_force(spark, tmp_path):
    """``run`` on a small corpus: each stage's rule applied in Python to the rows before it, but for the classifier, whose own rule is its score."""
    import corpus_pipeline
    import public_tokenizers
    import sentencepiece
    from graphloom.llm.quality import score_documents

    r = random.Random(11)
    good = [" ".join(r.choice(WORDS) + str(r.randrange(500)) for _ in range(40)) for _ in range(60)]
    rows = [(i, t + "\nshared footer line of all\n" + f"own line {i}", "en", f"s{i % 3}", 0) for i, t in enumerate(good)]
    rows += [(100 + i, rows[i][1] + " and", "en", "s0", 0) for i in range(5)] + [(200 + i, " ".join(w + "***" for w in good[i].split()), "en", "s1", 0) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i, *_ in rows], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    keep = {x.doc_id for x in score_documents(docs, labels).where("score >= 0.7").collect()}
    now = [(i, t, s) for i, t, _, s, _ in rows if i in keep]
    assert {i for i, *_ in now} >= set(range(60)) and not any(i >= 200 for i, *_ in now)
    seen, lines = [], []
    for i, t, s in now:
        out = []
        for x in t.split("\n"):
            if x not in seen:
                out.append(x)
            seen.append(x)
        if "".join(out).strip():
            lines.append((i, "\n".join(out), s))
    sets = [(i, shingles(t)) for i, t, _ in lines]
    comp = {i: i for i, _ in sets}
    for _ in range(len(sets)):
        for i, a in sets:
            for j, b in sets:
                if i < j and a and b and len(a & b) >= 0.8 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
        break
    kept = [x for x in lines if comp[x[0]] == x[0]]
    n = Counter(s for *_, s in kept)
    drawn = Counter()
    for i, t, s in kept:
        m = len(kept) / len(n) / n[s]
        u = int(hashlib.md5(f"20:{i}:0".encode()).hexdigest()[:13], 16) / 2**52
        p = c = math.exp(-m)
        k = 0
        while c <= u:
            k += 1
            p *= m / k
            c += p
        drawn[(i, t)] += k
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter({(i, tuple(sp.encode(t))): k for (i, t), k in (+drawn).items()})
    assert Counter((x.doc_id, tuple(x.ids)) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want


def test_long_texts_and_ties_are_scored(spark):
    """A very long text, equal texts and repeated rows: classifier and language model give each row a score of its text alone."""
    from graphloom.llm.mixing_lm import score_texts
    from graphloom.llm.quality import score_documents, train

    r = random.Random(5)
    long = " ".join(r.choice(WORDS) for _ in range(60_000))
    rows = [(1, long), (2, "same text here"), (3, "same text here"), (3, "same text here"), (4, long + "x"), (5, "a" * 300_000)] + [(10 + i, prose(20)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    q = score_documents(docs, labels).collect()
    lm = score_texts(docs).collect()
    for got in (q, lm):
        by = {}
        for x in got:
            by.setdefault(x.doc_id, set()).add(x.score)
        assert len(got) == len(rows) and by[2] == by[3] and len(by[3]) == 1 and all(math.isfinite(x.score) for x in got)
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in q) and all(x.score < 0 for x in lm)
    # repeated rows of a labelled id change nothing
    (w, b), (w2, b2) = train(docs, labels), train(docs.unionByName(docs), labels)
    assert np.array_equal(w, w2) and b == b2
