import random

import numpy as np
import pytest

import corpus_pipeline
from driftloom.llm import neardup, simhash

from . import data


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def sets(source):
    return [set(neardup.shingles(t).tolist()) for _, t, *_ in source]


def brute(source):
    """doc_id and component of each row, by the similarity of every pair."""
    s, label = sets(source), list(range(len(source)))
    for i in range(len(s)):
        for j in range(i):
            if jaccard(s[i], s[j]) >= 0.8 and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    least = {}
    for x, (doc_id, *_rest) in zip(label, source):
        if doc_id is not None:
            least[x] = min(doc_id, least.get(x, doc_id))
    return sorted(((d, least.get(x)) for x, (d, *_rest) in zip(label, source)), key=repr)


def copies():
    """Rows that differ in 1 to 6 words of 120, so their similarities lie on both sides of 0.8."""
    rng = random.Random(5)
    rows = list(data.rows(40))
    base = [data.words(rng, 120).split() for _ in range(6)]
    for i in range(90):
        w = list(base[i % 6])
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"changed{rng.randint(0, 99)}"
        rows.append((1000 + i, " ".join(w), "en", "s", 1))
    return rows


@pytest.mark.parametrize("small", [(16, 2048, 64), (2, 8, 1)])
def test_near_copies_equal_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(neardup, "CENTRES", small[2])
    monkeypatch.setattr(neardup, "SMALL", small[0])
    monkeypatch.setattr(simhash, "SMALL", small[0])
    monkeypatch.setattr(neardup, "SQUARE", small[1])
    source = copies()
    df = data.clashing(spark.createDataFrame(source, data.DOCS))
    assert data.as_rows(neardup.near_copies(df), "doc_id", "component_id") == brute(source)
    assert neardup.near_copies(data.empty(spark)).count() == 0


@pytest.mark.parametrize("square", [2048, 2])
def test_every_node_with_a_near_node_is_a_candidate(monkeypatch, square):
    """y is near to x and z, which are not near to each other: whichever comes first, all three are there."""
    monkeypatch.setattr(neardup, "SQUARE", square)
    monkeypatch.setattr(neardup, "SMALL", 1)
    monkeypatch.setattr(neardup, "CENTRES", 1)
    low, high = np.uint64(2**50 - 1), np.uint64(2**50 - 1)
    fp = np.array([[low, 0, 0, 0], [0, 0, 0, 0], [0, high, 0, 0], [0, 0, 2**64 - 1, 2**64 - 1]], np.uint64)
    for names in ((1, 2, 3, 4), (3, 1, 2, 4), (2, 3, 1, 4), (3, 2, 1, 4)):
        node = np.array(names, np.uint64)
        a, b, _ = neardup.centred(np.zeros(4, np.int64), fp, node)
        assert set(node[:3].tolist()) <= set(a.tolist()) | set(b.tolist())
        assert all(simhash.near(fp[names.index(i)], fp[names.index(j)], 60) for i, j in zip(a.tolist(), b.tolist()))


def test_whole_table_equals_brute_force(spark):
    source = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    found = neardup.near_copies(spark.createDataFrame(source, "doc_id long, text string"))
    got, want = (sorted(x) for x in (data.as_rows(found, "doc_id", "component_id"), brute(source)))
    assert sum(g == w for g, w in zip(got, want)) >= 0.998 * len(want)
    assert all(g[1] >= w[1] for g, w in zip(got, want))  # nothing is joined that brute force does not join


def test_stage_keeps_what_is_less_similar(spark):
    rng = random.Random(1)
    rows = []
    for i in range(40):  # pairs of similarity 0.6 to 0.75: five words of some 100 changed, apart from each other
        w = data.words(rng, 100 + i).split()
        rows.append((2 * i, " ".join(w), "en", "s", 1))
        for at in range(8, 88, 20):
            w[at] = "changed"
        rows.append((2 * i + 1, " ".join(w), "en", "s", 1))
    s = sets(rows)
    assert all(0.6 <= jaccard(s[2 * i], s[2 * i + 1]) < 0.8 for i in range(40))
    kept = corpus_pipeline.near_stage(spark, spark.createDataFrame(rows, data.DOCS), "")
    assert kept.count() == len(rows)


@pytest.mark.parametrize("rows", [1000, 2**30])
def test_candidates_at_the_least_similarity(rows):
    """Pairs of sets at 0.8: nearly all are near, and meet at an anchor of some table."""
    rng, scheme = np.random.default_rng(0), neardup.scheme_for(rows)
    assert all(t.width == scheme.tables[0].width for t in scheme.tables)
    for n in (9, 36, 90, 900):
        a, b = [], []
        for _ in range(400):
            x = rng.integers(0, 2**63, n + n // 9, dtype=np.uint64)
            a.append(simhash.majority(x[:n], neardup.WORDS))
            b.append(simhash.majority(x[n // 9 :], neardup.WORDS))
        a, b = np.array(a), np.array(b)
        met = np.zeros(len(a), bool)
        for t in scheme.tables:
            met |= np.bitwise_count(t.values(a) ^ t.values(b)) <= t.threshold
        assert (met & simhash.near(a, b, scheme.limit)).mean() > (0.9 if n == 9 else 0.95)


def template_pages(n, shared=75, own=25):
    """Pages whose shingles are, for a share of ``shared``, those of their template."""
    rng = random.Random(11)
    page = [rng.getrandbits(63) for _ in range(shared)]
    return [(i, np.unique(np.array(page + [rng.getrandbits(63) for _ in range(own)], np.uint64))) for i in range(n)]


@pytest.mark.parametrize("shared", [75, 79])
def test_pages_of_one_template_meet_nobody(spark, monkeypatch, shared):
    """Similarity 0.60 and 0.65 to each other: none links, and what is shuffled grows with the pages alone."""
    joined = []
    monkeypatch.setattr(neardup, "_links", lambda members: joined.append(members.count()) or members.selectExpr("0L as a", "0L as b").limit(0))
    monkeypatch.setattr(neardup, "_checked", lambda pairs, _sets: joined.append(pairs.count()) or pairs)
    for n in (300, 900):
        rows = [(i, i, bytes(s.tobytes())) for i, s in template_pages(n, shared, 100 - shared)]
        sets = spark.createDataFrame([(i, b) for i, _, b in rows], "node long, shingles binary")
        rooted = spark.createDataFrame([(i, r) for i, r, _ in rows], "fp long, root long")
        candidates = spark.createDataFrame([(0, i) for i in range(1, n)], "a long, b long")
        neardup._compared(candidates, rooted, sets)
        # a few: where a shingle of its own shares the cell of one of the template's
        assert sum(joined) < n / 20
        joined.clear()


@pytest.mark.parametrize("few", [1, 2, 8, 1000])
def test_the_prefix_filter_loses_no_pair(spark, monkeypatch, few):
    monkeypatch.setattr(neardup, "FEW", few)
    monkeypatch.setattr(neardup, "BLOCK", 7)
    rng, nodes = random.Random(3), []
    for group in range(8):
        base = [rng.getrandbits(63) for _ in range(rng.choice([1, 3, 9, 60]))]
        for _ in range(20):
            own = [x if rng.random() > 0.12 else rng.getrandbits(63) for x in base]
            nodes.append(np.unique(np.array(own[: rng.randint(max(1, len(own) * 8 // 10), len(own))], np.uint64)))
    named = {i: set(x.tolist()) for i, x in enumerate(nodes)}
    root = {i: i if rng.random() < 0.7 else i // 20 * 20 for i in named}
    rooted = spark.createDataFrame(list(root.items()), "fp long, root long")
    sets = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(nodes)], "node long, shingles binary")
    candidates = spark.createDataFrame([(i, (i + 1) % len(nodes)) for i in named], "a long, b long")
    found = [tuple(r) for r in neardup._compared(candidates, rooted, sets).select("a", "b").collect()]

    def joined(links):
        label = dict(root)
        for a, b in links:
            x, y = label[a], label[b]
            label = {k: x if v == y else v for k, v in label.items()}
        return {frozenset(k for k in label if label[k] == v) for v in label.values()}

    pairs = [(a, b) for a in named for b in named if a < b]
    want = [p for p in pairs if jaccard(named[p[0]], named[p[1]]) >= 0.8]
    if few == 1000:  # pairs; else links are those of a forest, which connect what pairs connect
        assert all(jaccard(named[a], named[b]) >= 0.8 for a, b in found)
    assert joined(found) == joined(want)
