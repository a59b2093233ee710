"""Exact repeats and near duplicates against brute force."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import blockdedup, graph, lshforest, meeting, suffixdedup

from llm_samples import WORD


def ordered(df):
    return sorted(((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def brute_bytes(docs, length=100):
    seen, out = set(), []
    for i, t in docs:
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            if s in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(s)
        out.append((i, len(b), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize(("hot", "hops", "weak"), [(64, 1 << 22, False), (0, 0, False), (0, 1 << 22, True)])
def test_suffix_sort(edge, hot, hops, weak, monkeypatch):
    """Anchors dealt out or not, messages by relays or not, and hashes that collide for every pair of suffixes."""
    monkeypatch.setattr(suffixdedup, "HOT", hot)
    monkeypatch.setattr(suffixdedup, "PART", 300)
    monkeypatch.setattr(meeting, "ONE_HOP", hops)
    if weak:
        monkeypatch.setattr(suffixdedup.SuffixOrder, "common", lambda self, a, b: np.full(len(a), self.length))
    got = suffixdedup.dedup(edge).collect()
    assert Counter((r.doc_id, r.n_bytes, bytes(r.kept)) for r in got) == Counter(brute_bytes(ordered(edge)))
    for r in got:
        assert sum(x.end - x.start for x in r.removed) == r.n_bytes - len(r.kept)


def test_merge_sort_orders_suffixes():
    r = np.random.default_rng(5)
    data = r.integers(0, 2, 400).astype(np.uint8)
    order = suffixdedup.SuffixOrder(data, 12)
    suffix = r.permutation(380)
    cut = np.array([0, 1, 60, 61, 63, 380])
    got = suffix[order.merge_sort(suffix, cut)]
    for i, j in zip(cut[:-1], cut[1:], strict=True):
        assert [data[s : s + 12].tobytes() for s in got[i:j]] == sorted(data[s : s + 12].tobytes() for s in suffix[i:j])
    a, b = np.array([0, 5, 7]), np.array([0, 9, 7])
    assert order.common(a, b).tolist() == [12, next((n for n in range(12) if data[5 + n] != data[9 + n]), 12), 12]


@pytest.mark.parametrize("hops", [1 << 22, 0])
def test_fixed_blocks(edge, hops, monkeypatch):
    monkeypatch.setattr(meeting, "ONE_HOP", hops)
    same_as_brute_blocks(edge)


def same_as_brute_blocks(edge, window=35):
    docs = ordered(edge)
    words = [(i, WORD.findall(t)) for i, t in docs]
    count = Counter(tuple(w[k : k + window]) for _, w in words for k in range(len(w) - window + 1))
    want = Counter()
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        want[(i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))] += 1
    assert Counter(tuple(r) for r in blockdedup.dedup(edge).collect()) == want


def brute_components(docs):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets, parent = [], {}
    for i, t in docs:
        w = WORD.findall(t.translate(lower))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()))

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if i is not None and j is not None and x and y and 100 * len(x & y) >= 85 * len(x | y):
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    return Counter((i, len(x), None if i is None else find(i)) for i, x in sets)


@pytest.mark.parametrize("block", [1024, 2])
def test_near_duplicates(spark, edge, block, monkeypatch):
    monkeypatch.setattr(lshforest, "BLOCK", block)
    monkeypatch.setattr(lshforest, "LEADERS", 1)
    assert Counter(tuple(r) for r in lshforest.near_duplicates(edge).collect()) == brute_components(ordered(edge))


def test_chains_in_blocks(spark, monkeypatch):
    """A chain of documents, each linked only with the next, is one component however it is dealt out."""
    monkeypatch.setattr(lshforest, "BLOCK", 3)
    monkeypatch.setattr(lshforest, "LEADERS", 1)
    words = [f"w{i}" for i in range(300)]
    rows = [(100 - k, " ".join(words[10 * k : 10 * k + 150])) for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in lshforest.near_duplicates(docs).collect())
    assert got == brute_components(ordered(docs)) and {c for _, _, c in got} == {91}


def test_components_both_ways(spark):
    r = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 60, (45, 2))]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        parent[q] = p
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame(edges, "a long, b long")
    for one_task in (10**6, 0):
        assert {x.node: x.root for x in graph.components(df, one_task).collect()} == want
    assert graph.components(df.limit(0)).count() == 0


def test_empty(empty):
    assert suffixdedup.dedup(empty).count() == 0 and blockdedup.dedup(empty).count() == 0 and lshforest.near_duplicates(empty).count() == 0
    assert lshforest.deduplicated(empty).columns == empty.columns


def test_signature_agreement():
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 63, 1000).astype(np.uint64)
    h = np.concatenate((np.sort(a), np.sort(np.concatenate((a[:900], r.integers(0, 1 << 63, 100).astype(np.uint64))))))
    minima = lshforest.signatures(h, np.array([0, 1000, 2000]))
    assert abs((minima[0] == minima[1]).mean() - 900 / 1100) < 0.2


def test_condensed_regions(spark, monkeypatch):
    """Hundreds of near copies in one batch: most rows are joined before the shuffle, and nothing is lost."""
    monkeypatch.setattr(lshforest, "KEEP", 4)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[:i] + ["x"] + words[i + 1 :])) for i in range(0, 200, 2)] + [(1000 + i, " ".join(f"o{i}v{k}" for k in range(50))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = Counter(tuple(r) for r in lshforest.near_duplicates(docs).collect())
    assert got == brute_components(ordered(docs))
    prefix, brief = np.zeros((10, 4), np.uint32), np.zeros((10, lshforest.HASHES), np.uint8)
    brief[9] = 1
    sent, joined, root = lshforest.condensed(prefix, brief, np.arange(10))
    assert sent.tolist() == [0, 1, 2, 3, 9] and joined.tolist() == [4, 5, 6, 7, 8] and set(root.tolist()) == {0}


def thue_morse(n):
    """Two unequal words of 2**n letters that polynomials modulo 2**64 can't tell apart from n = 10 on."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


@pytest.fixture(scope="module")
def structured(spark):
    """Texts that differ in one structured word, or one such line, only."""
    rows = []
    for n in (10, 11, 12):
        a, b = thue_morse(n)
        around = [f"w{n}x{i}" for i in range(34)]
        for k, w in enumerate((a, b)):
            rows.append((10 * n + k, " ".join(around[:17] + [w] + around[17:])))
            rows.append((10 * n + 2 + k, w))
        rows.append((10 * n + 5, "\n".join((a, b, a, f"{a} {b} {a}", f"{b} {a} {a}", f"{a} {b} {a}"))))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(2).cache()


def test_structured_words(spark, structured):
    got = suffixdedup.dedup(structured).collect()
    assert Counter((r.doc_id, r.n_bytes, bytes(r.kept)) for r in got) == Counter(brute_bytes(ordered(structured)))
    same_as_brute_blocks(structured)
    assert {r.n_removed for r in blockdedup.dedup(structured.where("doc_id % 10 < 2")).collect()} == {0}
    assert Counter(tuple(r) for r in lshforest.near_duplicates(structured).collect()) == brute_components(ordered(structured))


def test_one_id_for_all_rows(spark):
    """A third id is null, the others are one: rows are dealt out by their texts too, and repeats are found among them."""
    r = np.random.default_rng(3)
    words = [f"v{i}" for i in range(500)]
    texts = [" ".join(r.choice(words, 60)) for _ in range(40)]
    texts += [t + " " + texts[i][:200] for i, t in enumerate(texts[:10])]
    docs = spark.createDataFrame([(None if i % 3 == 0 else 5, t) for i, t in enumerate(texts)], "doc_id long, text string")
    same_as_brute_blocks(docs)
    got = suffixdedup.dedup(docs).collect()
    tie = {x.text: x.tie for x in docs.selectExpr("text", "pmod(xxhash64(text), 4294967296L) tie").collect()}
    rows = sorted(((x.doc_id, x.text) for x in docs.collect()), key=lambda x: (x[0] is not None, tie[x[1]]))
    assert Counter((x.doc_id, x.n_bytes, bytes(x.kept)) for x in got) == Counter(brute_bytes(rows))
    assert lshforest.deduplicated(docs.unionAll(docs)).count() >= len(set(texts))


def test_groups_are_bounded(spark, structured, monkeypatch):
    monkeypatch.setattr(meeting, "GROUP_BYTES", 2000)
    same_as_brute_blocks(structured)


def test_runs_join_parts_of_large_components(spark, monkeypatch):
    """Documents of one template, in groups of near copies: many parts of one large component of candidates."""
    monkeypatch.setattr(lshforest, "BLOCK", 8)
    monkeypatch.setattr(lshforest, "LEADERS", 1)
    monkeypatch.setattr(lshforest, "LEAST_AGREEMENT", 0.5)
    r = np.random.default_rng(1)
    template = [f"t{i}" for i in range(170)]
    rows = []
    for g in range(20):
        own = template + [f"g{g}w{i}" for i in range(60)]
        for k in range(3):
            text = own.copy()
            text[int(r.integers(170, 230))] = f"x{g}y{k}"
            rows.append((int(r.integers(0, 1 << 40)), " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(x) for x in lshforest.near_duplicates(docs).collect())
    want = brute_components(ordered(docs))
    assert len({c for _, _, c in want}) == 20 and got == want


def test_sets_with_rare_shingles_first():
    r = np.random.default_rng(7)
    base = [f"b{i}" for i in range(60)]
    texts = ["", "one two"]
    for _ in range(60):
        t = base.copy()
        for i in r.integers(0, 60, int(r.integers(0, 5))):
            t[i] = f"n{r.integers(0, 9)}"
        texts.append(" ".join(t[: int(r.integers(50, 61))]))
    sets = lshforest.Sets(pa.chunked_array([pa.array(texts)]))
    full = [{tuple(t.split()[k : k + 5]) for k in range(max(len(t.split()) - 4, 1))} if t else set() for t in texts]
    for i in range(len(texts)):
        want = [j for j in range(len(texts)) if j != i and full[i] and full[j] and 100 * len(full[i] & full[j]) >= 85 * len(full[i] | full[j])]
        assert sets.linked(i, np.array([j for j in range(len(texts)) if j != i])).tolist() == want
