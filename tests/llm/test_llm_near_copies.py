import hashlib
import random
import tracemalloc

import numpy as np
import pytest
import xxhash

from inkloom.llm import simhash as S
from inkloom.llm import suffix_dedup as D
from inkloom.llm.graph import components


def brute_fingerprint(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = [x for x in w.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").split(" ") if x]
    shingles = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(nodes, near):
    root = list(range(len(nodes)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(nodes)):
        for b in range(a):
            if near(nodes[a], nodes[b]):
                root[find(a)] = find(b)
    return [find(a) for a in range(len(nodes))]


def test_fingerprints_and_components(edge_docs, edge_rows):
    fps = [brute_fingerprint(t) for _, t in edge_rows]
    root = groups(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    want = []
    for (doc, _), fp, r in zip(edge_rows, fps, root, strict=True):
        ids = [d for (d, _), q in zip(edge_rows, root, strict=True) if q == r and d is not None]
        want.append((doc, f"{fp:016x}", min(ids, default=None)))
    got = [tuple(r) for r in S.query(edge_docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_links_connect_like_brute_force(spark):
    """Chains and clouds of fingerprints, with cells so small that all are dealt into blocks."""
    rng = np.random.default_rng(2)
    fps = {0, 2**64 - 1}
    for _ in range(12):
        x = int(rng.integers(0, 2**63)) * 2 + 1
        for _ in range(int(rng.integers(2, 25))):
            for _ in range(int(rng.integers(1, 4))):
                x ^= 1 << int(rng.integers(0, 64))
            fps.add(x)
    fps = sorted(fps)
    root = groups(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    want = {}
    for fp, r in zip(fps, root, strict=True):
        want.setdefault(r, set()).add(fp)
    frame = spark.createDataFrame(
        [(int(np.uint64(x).astype(np.int64)),) for x in fps], "c0 bigint")
    for cell_rows in (3, 4096):
        edges = S.links(frame, S.EXACT, cell_rows)
        found = {}
        for r in components(edges).collect():
            found.setdefault(r.root, set()).add(int(r.node) & (2**64 - 1))
        alone = [{x} for x in fps if not any(x in g for g in found.values())]
        assert sorted(map(sorted, [*found.values(), *alone])) == sorted(map(sorted, want.values()))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 50)] + [(100, 101), (101, 100), (7, 7), (200, None)]
    got = {r.node: r.root for r in components(
        spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_one_of_each_group_stays(spark, edge_docs, no_docs):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    text = list(rng.choice(vocabulary, 400))
    edited = list(text)
    edited[100], edited[300] = "new", "other"
    half = text[:200] + list(rng.choice(vocabulary, 200))
    rows = [(1, " ".join(text)), (2, " ".join(edited)), (2, " ".join(edited)), (3, " ".join(half)),
            (4, " ".join(rng.choice(vocabulary, 400)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in S.one_per_group(docs).collect()) == [1, 3, 4]
    kept = S.one_per_group(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(5) == 2 and 6 not in ids and 4 in ids  # one of the copies, and another text
    assert S.one_per_group(no_docs).count() == 0 and S.query(no_docs).count() == 0


def test_repeated_shingles_count_once(spark):
    """A passage that two unrelated texts repeat is a small part of their shingle sets."""
    rng = np.random.default_rng(6)
    menu = " ".join(f"menu{i}" for i in range(14))

    def page(doc):
        own = [f"d{doc}w{i}" for i in rng.permutation(600)]
        return " ".join(" ".join(own[a:a + 20]) + " " + menu for a in range(0, 600, 20))

    texts = [page(i) for i in range(3)]
    fps = [S.fingerprint(t.encode(), S.WIDE) for t in texts]
    assert all(np.bitwise_count(fps[a] ^ fps[b]).sum() > 120 for a in range(3) for b in range(a))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert S.one_per_group(docs).count() == 3


def jaccard_pair(rng, name, n, similarity):
    """Two texts of about n words whose five-word shingle sets have about this similarity."""
    words = [f"{name}w{i}" for i in range(n)]
    other, at = list(words), 0
    # An exchanged word in the middle costs five shingles on either side.
    lost = round((n - 4) * (1 - similarity) / (1 + similarity))
    for at in range(lost // 5):
        other[10 + 8 * at] = f"{name}x{at}"
    return " ".join(words), " ".join(other)


def brute_sets(texts, k=5):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        out.append({" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return out


def test_similarity_decides_on_shingle_sets(spark):
    """Pairs from 0.70 to 0.90, a chain of them, a family of templates below 0.8, repeated passages."""
    rng = np.random.default_rng(8)
    texts = []
    for n, similarity in enumerate(np.repeat(np.arange(0.70, 0.905, 0.01), 4)):
        texts += jaccard_pair(rng, f"p{n}", 300, similarity)
    frame = [f"f{i}" for i in range(240)]
    for d in range(25):  # every two share the frame alone
        texts.append(" ".join([*frame, *(f"own{d}n{i}" for i in range(44))]))
    menu = " ".join(f"m{i}" for i in range(14))
    for d in range(4):
        texts.append(" ".join(f"r{d}n{i} {menu}" if i % 20 == 0 else f"r{d}n{i}" for i in range(600)))
    # Equal sets in another order, short texts, and none.
    texts += ["a b c d e f", "A b c d e f", "a b c", "a b c d", "a b c", "", None, " \t"]
    sets = brute_sets(texts)

    def near(a, b):
        return len(a & b) * 5 >= len(a | b) * 4

    root = groups(sets, near)
    want = sorted({r: i for i, r in reversed(list(enumerate(root)))}.values())
    exact = [len(a & b) / len(a | b) for a, b in zip(sets[:168:2], sets[1:168:2], strict=True)]
    assert min(exact) < 0.72 and max(exact) > 0.88 and sum(0.77 < x < 0.8 for x in exact) > 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    for cell_rows in (2, 4096):
        assert sorted(r.doc_id for r in S.one_per_group(docs, S.WIDE, cell_rows).collect()) == want


def brute_removed(rows, length, keep):
    raws = [(t or "").encode() for _, t in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    first, count = {}, {}
    for i in order:
        for p in range(len(raws[i]) - length + 1):
            s = raws[i][p:p + length]
            count[s] = count.get(s, 0) + 1
            first.setdefault(s, (i, p))
    out = []
    for i, raw in enumerate(raws):
        gone = [False] * len(raw)
        for p in range(len(raw) - length + 1):
            s = raw[p:p + length]
            if count[s] > 1 and (keep == "none" or first[s] != (i, p)):
                gone[p:p + length] = [True] * length
        out.append(bytes(b for b, g in zip(raw, gone, strict=True) if not g))
    return out


def test_repeated_passages(spark, monkeypatch):

    for seed in range(2):
        rng = random.Random(seed)

        def noise(n, rng=rng):
            return "".join(rng.choice("ab cdé") for _ in range(n))

        known = [noise(60) for _ in range(4)]
        rows = [(i, "".join(rng.choice([
            noise(rng.randint(0, 30)), rng.choice(known), rng.choice(known)[5:50],
            "a" * rng.randint(0, 60), "xyz" * rng.randint(0, 20)]) for _ in range(4)))
            for i in range(30)]
        rows += [(100, None), (101, ""), (102, rows[3][1]), (None, rows[4][1])]
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
        monkeypatch.setattr(D, "CHUNK", 64 if seed else 1 << 20)
        for group_bytes in (1 << 22, 200):
            for keep in ("none", "first"):
                spans = {r.d: [s.asDict() for s in r.spans]
                         for r in D.repeated_spans(docs, 20, keep, group_bytes).collect()}
                want = brute_removed(rows, 20, keep)
                for (i, t), left in zip(rows, want, strict=True):
                    got = spans.get(-(1 << 63) if i is None else i, [])
                    assert D.cut_text((t or "").encode(), D.merge(got)) == left


def shared(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("length", [1, 3, 6, 8, 13, 40])
def test_suffix_order_and_factors(length):
    rng = random.Random(length)
    texts = [b"banana bandana banana" * 3, b"a" * 90, bytes(rng.choice(b"ab") for _ in range(150)),
             bytes(rng.choice(b"ab\0") for _ in range(120)), bytes(range(90)) * 2]
    for raw in texts:
        b = np.frombuffer(raw, np.uint8)
        starts = np.array([p for p in range(len(b) - length + 1) if p % 7 != 3])
        order, common = D.suffix_order(b, starts, length)
        cut = [raw[p:p + length] for p in starts]
        want = sorted(range(len(starts)), key=lambda i: (cut[i], i))
        assert order.tolist() == want
        assert common.tolist() == [0] + [shared(cut[i], cut[j]) for i, j in zip(want, want[1:], strict=False)]
        before = [max([shared(cut[i], cut[j]) for j in range(i)], default=0) for i in range(len(cut))]
        behind = [max([shared(cut[i], cut[j]) for j in range(i + 1, len(cut))], default=0) for i in range(len(cut))]
        assert D.factors(b, starts, length).tolist() == before
        assert D.factors(b, starts, length, later=True).tolist() == behind


def test_query_at_its_length(spark):
    """Every digest of the registered query, at 400 bytes, against brute force."""
    rng = random.Random(21)

    def noise(n):
        return "".join(rng.choice("abcdé \U0001f600") for _ in range(n))

    shared_, twice, near = noise(420), noise(380), noise(330)
    rows = [(1, noise(90) + shared_ + noise(50)), (2, shared_ + noise(300)), (3, noise(200) + shared_[3:]),
            (4, twice + "x" + twice), (5, near), (6, near), (7, "ab" * 450), (8, None), (9, ""), (10, shared_[:150]),
            (11, noise(700)), (12, noise(40) + "ab" * 260)]
    got = {r.doc_id: r for r in D.query(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    raw = {i: (t or "").encode() for i, t in rows}
    seen = {}
    for i, t in raw.items():
        for p in range(len(t) - 399):
            seen.setdefault(t[p:p + 400], []).append((i, p))
    gone = {i: bytearray(len(t)) for i, t in raw.items()}
    for places in seen.values():
        for i, p in places if len(places) > 1 else ():
            gone[i][p:p + 400] = b"\1" * 400
    assert sum(map(sum, gone.values())) > 3000
    for i, t in raw.items():
        left = bytes(c for c, g in zip(t, gone[i], strict=True) if not g)
        runs = sum(1 for p, g in enumerate(gone[i]) if g and not (p and gone[i][p - 1]))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256, got[i].text) == (
            len(t), sum(gone[i]), runs, hashlib.sha256(left).hexdigest(), left.decode(errors="replace"))


def test_dedup_edges(spark, edge_docs, no_docs):
    out = D.dedup(edge_docs, 100)
    assert out.columns == edge_docs.columns and out.count() == edge_docs.count()
    texts = {(r.doc_id, r.text) for r in out.collect()}
    assert (1, None) in texts and (2, "") in texts and (6, "") in texts
    wide = "".join(chr(0x100 + i) for i in range(80))
    cut = D.dedup(spark.createDataFrame([(1, "x" + wide), (2, "yz" + wide)],
                                        "doc_id bigint, text string"), 150)
    left = {r.doc_id: r.text for r in cut.collect()}
    assert left == {1: "x" + wide, 2: "yz"}
    rows = {r.doc_id: r for r in D.query(edge_docs).collect()}
    assert rows[4].n_removed == 0 and rows[6].n_removed == rows[6].n_bytes
    assert D.query(no_docs).count() == 0


def test_sorting_a_full_task_holds_little():
    """The largest frame that one task may sort at once, in all its arrays."""
    size = D.GROUP_BYTES + D.BATCH_BYTES
    b = np.random.default_rng(3).integers(97, 123, size).astype(np.uint8)
    tracemalloc.start()
    try:
        hit = D.repeated_starts(b, np.arange(0, size - D.LENGTH, 4), D.LENGTH, "none")
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert not hit.any()
    assert peak < 160 << 20
