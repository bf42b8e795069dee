"""Token alignment, mixing and whitening against brute force on small tables with nulls, odd texts, ties and repeats."""

import collections
import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from minutewise.llm import alignment, mixing, whitening  # noqa: E402
from minutewise.llm.token_counts import byte_symbols  # noqa: E402

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = list("ab cdE'sΣİ́é \n\t\r\x1c\x85\xa0 ​1٣²!?<|>漢字ｶﾞ　éÅÅͅßﬁ▁😀") + ["<|endoftext|>", "</s>", "'ll", "'RE", "  ", " \n ", "\n\n", ";\r\n", "<0x41>"]


class Both:
    """Both libraries' tokens of a whole text, and its groups by common ends."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(BYTES)
        self.a.encode_special_tokens = True
        shown = {c: b for b, c in enumerate(byte_symbols())}
        self.a_bytes = {i: bytes(map(shown.get, t)) for t, i in self.a.get_vocab(with_added_tokens=False).items() if set(t) <= set(shown)}
        self.b = sentencepiece.SentencePieceProcessor(model_file=PIECES)

    def b_bytes(self, i):
        t = self.b.id_to_piece(i)
        return bytes([int(t[3:5], 16)]) if self.b.is_byte(i) else t.replace("▁", " ").encode()

    def groups(self, text):
        if not text:
            return []
        a, b = self.a.encode(f" {text}", add_special_tokens=False).ids, self.b.encode(text)
        parts = [[self.a_bytes[i] for i in a], [self.b_bytes(i) for i in b]]
        if any(b"".join(p) != f" {text}".encode() for p in parts):
            return []
        ends = [np.cumsum([len(t) for t in p]).tolist() for p in parts]
        out, x, y = [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            i, j = ends[0].index(e) + 1, ends[1].index(e) + 1
            out.append((a[x:i], b[y:j]))
            x, y = i, j
        return out


def expected_alignment(texts):
    both = Both()
    groups = [both.groups(t) for t in texts]
    n = collections.Counter((a[-1], b[-1]) for g in groups for a, b in g)
    best = collections.Counter()
    for (_, b), k in n.items():
        best[b] = max(best[b], k)
    out = []
    for g in groups:
        links = [(a[-1], b[-1]) for a, b in g]
        said = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        numbers = [sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(n[p] == best[p[1]] for p in links), sum(n[p] for p in links)]
        out.append((*numbers, hashlib.sha256(said.encode()).hexdigest() if g else ""))
    return out


ALIGNED = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def odd_texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choices(ODD, k=rng.randrange(1, 40))) for _ in range(n)]


@pytest.mark.parametrize("broadcast", [2_000_000, 0])
def test_alignment(spark, monkeypatch, broadcast):
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", broadcast)
    texts = [None, "", " ", "\n", "x ", "a" * 3000, "one two " * 400, "one two", "one two", *odd_texts(3, 120)]
    rows = [(i if i != 7 else None, t, 1, 2) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, code int, n_a int").repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in ALIGNED) for r in alignment.alignment_query(docs, BYTES, PIECES).collect()}
    want = expected_alignment(texts)
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert got[rows[i][0]] == w, texts[i]
    assert alignment.alignment_query(docs.where("false"), BYTES, PIECES).count() == 0


def test_alignment_all_over_unicode_and_with_a_full_cache(monkeypatch):
    monkeypatch.setattr(alignment, "KEPT", 2000)
    monkeypatch.setattr(alignment, "CHUNK", 50)
    aligner, both = alignment.Aligner(BYTES, PIECES), Both()
    texts = ["".join(map(chr, range(i, min(i + 23, 0xD800)))) for i in range(0, 0xD800, 23)] + odd_texts(4, 400)
    for at in range(0, len(texts), 97):
        for t, (numbers, digest, _, times) in zip(texts[at : at + 97], aligner.align(texts[at : at + 97]), strict=True):
            g = both.groups(t)
            said = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
            assert digest == (hashlib.sha256(said.encode()).hexdigest() if g else ""), t
            assert numbers[2] == len(g) == times.sum()


def test_union_find_components_are_the_smallest_groups():
    rng = np.random.default_rng(1)
    for _ in range(100):
        n = int(rng.integers(2, 60))
        ends = [np.unique(np.r_[rng.integers(1, n + 1, rng.integers(1, n + 1)), n]) for _ in range(2)]
        stretch = np.union1d(*ends)
        a, b = (np.searchsorted(e, stretch) for e in ends)
        root = alignment.components(a, b + len(ends[0]), len(ends[0]) + len(ends[1]))
        common = np.intersect1d(*ends)
        assert len(np.unique(root)) == len(common)
        assert (np.searchsorted(common, ends[0]) == np.unique(root[: len(ends[0])], return_inverse=True)[1]).all()


def water_filling(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_ = dict.fromkeys(order, 0.0), set(order)
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2.0 * sizes[s] for s in order if s not in open_)
        level = left / sum(w[s] for s in open_) if open_ else 0
        above = {s for s in open_ if w[s] * level > 2 * sizes[s]}
        for s in open_:
            target[s] = w[s] * level
        if not above:
            break
        for s in above:
            target[s] = 2.0 * sizes[s]
        open_ -= above
    return target


def mixed_docs(spark):
    rng = random.Random(9)
    rows = []
    for i in range(400):
        source = rng.choice(["web", "web", "web", "", "é", "Z", None, "tiny"]) if i > 3 else "tiny"
        n = rng.choice([0, 1, 5, 30, 200]) if source != "tiny" else rng.choice([0, 3])
        rows.append((rng.choice([i, i, i, 7, None]), " \n".join("w" * rng.randrange(1, 9) for _ in range(n)) if n or rng.random() < 0.5 else None, source, 5))
    rows += [(77, "same words here", "web", 5)] * 60 + [(9999, "word " * 20_000, "web", 5), (10000, None, "nothing", 5)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(4)


@pytest.mark.parametrize("shard", [500_000, 700])
def test_mixing(spark, shard):
    rows, docs = mixed_docs(spark)
    out, quotas = mixing.mix(docs, shard=shard)
    got = out.collect()
    size = lambda t: len((t or "").replace("\n", " ").split())
    assert collections.Counter((r["doc_id"], r["source"], r["size"]) for r in got) == collections.Counter((i, s, size(t)) for i, t, s, _ in rows)
    sizes, taken = collections.Counter(), collections.Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    target = water_filling(sizes)
    shards = collections.Counter(r["place"] for r in quotas.collect())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], target[r["source"]], rel_tol=1e-12, abs_tol=1e-9)
    for i, s in enumerate(order):
        assert abs(taken[s] - target[s]) <= 8 + 16 * shards[i]
    again = mixing.mix(docs.repartition(2), shard=shard)[0].collect()
    assert collections.Counter(again) == collections.Counter(got)


def test_mixing_like_its_sql(spark):
    _, docs = mixed_docs(spark)
    table = docs.toPandas()
    con = duckdb.connect()
    con.register("documents", table.astype({"doc_id": "Int64"}))
    want = collections.Counter(con.execute(mixing.MIXING_SQL).fetchall())
    assert collections.Counter(map(tuple, mixing.mixing_query(docs).collect())) == want
    assert mixing.mixing_query(docs.where("false")).count() == 0
    assert {tuple(r)[1:] for r in mixing.mixing_query(docs.where("source = 'nothing'")).collect()} == {(0, 0, 0.0, 0)}


def seats(weights, n):
    """Sainte-Laguë by listing quotients."""
    listed = sorted((-w / (2 * k + 1), i) for i, w in enumerate(weights) if w for k in range(n))[:n]
    return [sum(i == j for _, j in listed) for i in range(len(weights))]


def test_apportionment_like_the_list_of_quotients(spark):
    rng = random.Random(2)
    groups = []
    for g in range(60):
        m = rng.randrange(1, 30)
        weights = [float(rng.choice([0, 1, 1, 2, 3, rng.randrange(1, 2000), 10**6])) for _ in range(m)]
        groups.append((weights, rng.randrange(0, 60) if any(weights) else 0))
    rows = [(g, i, w, n) for g, (weights, n) in enumerate(groups) for i, w in enumerate(weights)]
    out = mixing.apportion(spark.createDataFrame(rows, "g int, i int, w double, n long"), ["g"], "w", "n", ["i"], "got")
    got = {(r["g"], r["i"]): r["got"] for r in out.collect()}
    for g, (weights, n) in enumerate(groups):
        assert [got[g, i] for i in range(len(weights))] == seats(weights, n), (weights, n)


def expected_whitening(vectors, k=16):
    usable = [v for v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in usable]
    fit = sorted(set(map(tuple, x)))
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    far = lambda row: [n * c - t for c, t in zip(row, s, strict=True)]
    centred = np.array([far(r) for r in fit], float) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    keep = min(k, int((e > 1e-11 * e[0]).sum()))
    total = sum(c * c for r in fit for c in far(r)) / n**3
    return n, [sum(c * c for c in far(r)) for r in x], (np.array([far(r) for r in x], float) / n) @ (v[:, :keep] / np.sqrt(e[:keep])), e[:keep] / total


@pytest.mark.parametrize("d", [3, 24, 120])
def test_whitening(spark, d):
    rng = np.random.default_rng(d)
    base = rng.normal(size=(250, d)) * np.linspace(0.5, 3, d)
    vectors = [[float(np.float32(c)) for c in v] for v in base] + [[0.25] * d] * 40
    rows = [(i, v, 3, "x") for i, v in enumerate(vectors)]
    odd = [(900, None), (901, [None] * d), (902, [float("nan")] * d), (903, [float("inf"), *[0.0] * (d - 1)]), (904, []), (905, [1.0]), (906, [1e30, *[0.0] * (d - 1)])]
    table = spark.createDataFrame(rows + [(i, v, 3, "x") for i, v in odd] + [rows[0], (None, vectors[1], 3, "x")], "vec_id long, embedding array<float>, n int, x string").repartition(3)
    n, far, want, share = expected_whitening(vectors)
    got = collections.defaultdict(dict)
    out = whitening.whitening_query(table).collect()
    assert len(out) == (len(vectors) + 2) * len(share)
    for r in out:
        if r["vec_id"] is not None:
            got[r["vec_id"]][r["component"]] = r
    sign = [1 if got[0][c + 1]["whitened"] * want[0][c] > 0 else -1 for c in range(len(share))]
    for i in range(len(vectors)):
        assert sorted(got[i]) == list(range(1, len(share) + 1))
        for c, r in got[i].items():
            assert (r["n"], r["deviation"]) == (n, far[i]) and r["identity_error"] < 1e-9
            assert math.isclose(r["whitened"], sign[c - 1] * want[i][c - 1], rel_tol=1e-6, abs_tol=1e-7) and math.isclose(r["explained"], share[c - 1], rel_tol=1e-9)


def test_whitening_without_variance_or_full_rank(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whitening_query(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitening_query(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    line = [(i, [i / 64.0, 3.0 + 2 * i / 64.0, 0.0]) for i in range(9)]
    got = whitening.whitening_query(spark.createDataFrame(line, schema)).collect()
    assert {r["component"] for r in got} == {1} and all(math.isclose(r["explained"], 1.0) and r["identity_error"] < 1e-9 for r in got)


def test_deviations_of_any_size():
    rng = np.random.default_rng(3)
    for spread, n in ((50, 10), (50, 10**9), (10**6, 10**7), (2**50, 10**10)):
        x = rng.integers(10**6 - spread, 10**6 + spread, (20, 5))
        sums = [int(s) for s in x.astype(object).sum(0) * (n // 20) + 7]
        got = whitening.Centre(n, sums).deviations(x)
        assert got == [sum((n * int(c) - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x]
