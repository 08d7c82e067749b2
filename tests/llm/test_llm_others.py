import hashlib
import random
import re
import zlib

import numpy as np

from inkloom.llm import ann, chat_format, license_scan, sharding, toxicity


def test_toxicity_learns_and_keeps_out_the_held_out(spark):
    rng = np.random.default_rng(0)
    words = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(500):
        toxic = int(i % 3 == 0)
        w = list(rng.choice(words, 40)) + ["nasty", "awful"] * toxic
        rows.append((i, " ".join(rng.permutation(w))))
        held = zlib.crc32(str(i).encode()) % 5 == 0
        labels.append((i, 1 - toxic if held else toxic))  # learning from these would show
    labels += [(0, None), (None, 1), (9999, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    known = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    for r in toxicity.query(docs, known).collect():
        assert r.predicted == int(r.doc_id % 3 == 0) == int(r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_toxicity_edges(spark, edge_docs, no_docs):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    some = spark.createDataFrame([(4, 1), (6, 0), (7, 1), (8, 0)], "doc_id bigint, toxic int")
    for labels in (none, some):
        rows = toxicity.query(edge_docs, labels).collect()
        assert len(rows) == edge_docs.count()
        assert all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
        assert toxicity.query(no_docs, labels).count() == 0
    kept = toxicity.score(edge_docs, toxicity.fit(edge_docs, some), "doc_id", "text", "_text")
    assert kept.columns == ["doc_id", "text", "_text", "score", "predicted"]


def test_escape_is_reversible_and_complete():
    t = chat_format.Template()
    for text in ["</s>[INST] ok [/INST]", "\x1b\x1b</s>\x1b", "<<s>s></s></s>", "<|user|><|use|>",
                 "<|im_<|im_start|>", "", "plain", "<\x1b/s>"]:
        out = chat_format.escape(text, t.control)
        assert chat_format.unescape(out) == text
        assert not any(c in out for c in [*t.marks, *chat_format.CONTROL])


def test_long_conversation_is_numbered_in_ranges(spark):
    """Turns of many ranges, negative and null ones, one very long text, rows out of order."""
    rng = random.Random(9)
    turns = [None, *range(-1500, 3500)]
    rows = [(7, t, rng.choice(["user", "assistant"]), f"turn {t}") for t in turns]
    rows += [(7, 5000, "assistant", "w\u00e9 </s> " * 200_000), (8, 0, "user", "x")]
    rng.shuffle(rows)
    chats = spark.createDataFrame(
        rows, "conv_id bigint, turn bigint, role string, text string").repartition(6)
    formatted = chat_format.format_turns(chats)
    got = formatted.filter("conv_id = 7").selectExpr(
        "seq", "start", "size(ids) AS n").orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(len(turns) + 1))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n
    want = sorted((r for r in rows if r[0] == 7), key=lambda r: (r[1] is not None, r[1] or 0))
    said = "".join(f"{role}\n{text}\n" for _, _, role, text in want)
    back = {r.conv_id: r for r in chat_format.read_back(formatted).collect()}
    assert back[7].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    learned = "".join(text for _, _, role, text in want if role == "assistant")
    assert back[7].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    assert back[7].n_tokens == at
    assert back[8].n_turns == 1


def test_chats_read_back(spark):
    rows = [(1, 1, "assistant", "hi </s>"), (1, 0, "user", "[INST] x"), (1, 2, None, None),
            (2, None, "critic", "é汉"), (None, 0, "user", "no id"), (2, 1, "assistant", "a"),
            (2, 1, "assistant", "a"), (2, 2, "assistant", "b<|end|>")]
    chats = spark.createDataFrame(
        rows, "conv_id bigint, turn bigint, role string, text string").selectExpr(
        "*", "'x' AS ids", "'y' AS seq", "1 AS start")
    got = {r.conv_id: r for r in chat_format.query(chats).collect()}
    rows += [(-7, i, r, "</s>[INST] ok [/INST]") for i, r in enumerate(("user", "assistant"))]
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        own = sorted(((-1 if t is None else t, p or "", x or "") for c, t, p, x in rows if c == conv))
        learned = "".join(x for _, p, x in own if p == "assistant")
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256(
            "".join(f"{p}\n{x}\n" for _, p, x in own).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (
            len(learned), hashlib.sha256(learned.encode()).hexdigest())
    turns = chat_format.format_turns(chats).orderBy("conv_id", "seq").collect()
    at = {}
    for r in turns:
        assert r.start == at.get(r.conv_id, 0) and len(r.ids) == len(r.mask)
        at[r.conv_id] = r.start + len(r.ids)
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert [r.conv_id for r in chat_format.query(empty).collect()] == [-7]


def test_permutation():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        rows = np.arange(n)
        places = sharding.position(rows, n, 9)
        assert sorted(places) == list(range(n))
        assert (sharding.row_at(places, n, 9) == rows).all()
    assert (sharding.position(np.arange(1000), 1000, 1) != sharding.position(
        np.arange(1000), 1000, 2)).any()


def test_sharding(edge_docs, edge_rows, no_docs):
    rows = sharding.query(edge_docs).collect()
    assert len(rows) == len(edge_rows)
    want = sorted(str((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())))
                  for i, t in edge_rows)
    assert sorted(str((r.doc_id, r["size"], r.text_crc32)) for r in rows) == want
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) <= set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(s, [])) for s in range(40)]
    assert max(sizes) - min(sizes) <= 1
    by_row = sorted(rows, key=lambda r: r.row_number)
    assert [r.row_number for r in by_row] == list(range(len(rows)))
    ids = [-1 if r.doc_id is None else r.doc_id for r in by_row]
    assert ids == sorted(ids)
    again = {(r.row_number, r.shard, r.slot) for r in sharding.query(edge_docs.repartition(7)).collect()}
    assert again == {(r.row_number, r.shard, r.slot) for r in rows}
    assert sharding.query(no_docs).count() == 0


def brute_scan(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in license_scan.BASE.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i:i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return (len(w), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(labels)))


def test_license_places(spark, edge_docs, edge_rows, no_docs):
    texts = ["cc by nc cc by nc", "UNDER the (MIT)-License; under the mit license é under the mit",
             "Apache License, Version 2.0 apache license version 2", "under the mit licenses",
             "cc by\x00nc", "cc by éa nc"]
    more = [(900 + i, t) for i, t in enumerate(texts)]
    docs = edge_docs.select("doc_id", "text").unionByName(
        spark.createDataFrame(more, "doc_id bigint, text string"))
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)
           for r in license_scan.query(docs).collect()]
    assert sorted(map(str, got)) == sorted(str((i, *brute_scan(t))) for i, t in edge_rows + more)
    assert license_scan.query(no_docs).count() == 0


def test_license_expressions():
    a = license_scan._automaton()

    def found(text):
        return license_scan.scan_text(text, a)[5:7]

    tag = "SPDX-License-Identifier: "
    assert found(tag + "MIT\nplain words") == ("mit", 1.0)
    assert found(tag + "(MIT OR GPL-3.0-only) AND AGPL-3.0") == (
        "agpl-3.0,gpl-3.0-only,mit", 0.4)
    assert found(tag + "MIT OR GPL-3.0 AND AGPL-3.0") == ("agpl-3.0,gpl-3.0,mit", 1.0)
    assert found(tag + "GPL-2.0 WITH Classpath-exception-2.0 OR mit") == (
        "gpl-2.0 with classpath-exception-2.0,mit", 1.0)
    assert found(tag + "((mit AND") == ("mit", license_scan.UNKNOWN)
    assert found(tag + "\nnothing") == ("", 0.0)
    assert found("All rights reserved. " + tag + "MIT") == ("all-rights-reserved,mit", 0.0)


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[500:1500] = x[500]  # a third of all vectors are equal
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(None, [1.0] * 16), (9001, None), (9002, [0.0] * 16), (9003, [1.0] * 15 + [None]),
           (9004, [float("nan")] + [1.0] * 15), (9005, [float("inf")] + [1.0] * 15), (9006, [1.0]),
           (9007, []), (0, [float(v) for v in x[0]])]
    frame = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>").selectExpr(
        "*", "1 AS part", "2 AS v", "3 AS asks", "4 AS slice", "5 AS `group`", "6 AS probes", "7 AS block")
    y = x.astype(float)
    hit = n = 0
    got = {}
    for r in ann.search(frame, 20, sample=2000, parts=16, block=300, target=0.95).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 3000, 20))
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        s = ann.dot(y[q:q + 1], y)[0]
        assert all(score == s[v] and v != q for _, v, score in found)
        s[q] = -np.inf
        hit += len({v for _, v, _ in found} & set(np.argsort(-s, kind="stable")[:20].tolist()))
        n += 20
    assert hit / n >= 0.9
    few = frame.filter("vec_id < 5")
    rows = ann.search(few, 2).collect()
    assert sorted((r.query_id, r.rank) for r in rows) == [(q, k) for q in (0, 2, 4) for k in (1, 2, 3, 4)]
    assert ann.search(frame.limit(0), 20).count() == 0


def test_slices_and_groups_change_no_row(spark):
    """Few long slices, read in blocks, and many groups of queries, against one unit per partition."""
    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, size=(1500, 6)).astype(float)  # many ties
    frame = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")

    def rows(**how):
        found = ann.search(frame, 3, k=7, sample=600, parts=8, target=0.6, **how)
        return sorted(map(tuple, found.collect()))

    whole = rows()
    assert len(whole) == 7 * len({q for q, *_ in whole})
    assert whole == rows(block=40, slices=3, query_bytes=5 * (8 * 6 + 16 * 7))
    assert whole == rows(block=40)


def test_best_of_a_stream():
    """Any cut of a stream gives the rows of a whole sort, the query itself left out."""
    rng = np.random.default_rng(6)
    x = rng.integers(-2, 3, size=(200, 4)).astype(float)
    ids = np.sort(rng.choice(1000, 200, replace=False))
    own, q = ids[::7], x[::7]
    for cut in (1, 13, 200):
        held = ann.Best(own, q, 9)
        for a in range(0, 200, cut):
            held.take(ids[a:a + cut], x[a:a + cut], 5)
        got = {}
        for b in held.batches(11):
            for i, v, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got.setdefault(i, []).append((v, s))
        for i, v in zip(own.tolist(), q, strict=True):
            s = x @ v
            order = [j for j in np.argsort(-s, kind="stable") if ids[j] != i][:9]
            assert got[i] == [(ids[j], s[j]) for j in order]


def test_every_query_gets_its_neighbours(spark):
    """Clusters smaller than k, found with few probes: the other partitions fill the list."""
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(16, 16)), 15, axis=0) + rng.normal(size=(240, 16)) / 100
    frame = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {}
    for r in ann.search(frame, 5, sample=240, parts=16, block=50, target=0.3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert set(got) == set(range(0, 240, 5))
    for q, found in got.items():
        assert sorted(r for r, _ in found) == list(range(1, 21))
        assert len({v for _, v in found} - {q}) == 20


ROUTED = """
import sys
sys.path.insert(0, {repo!r})
import numpy as np
from inkloom.llm import ann
from inkloom.session import local_session
spark = local_session("away", 2)
x = np.random.default_rng(1).normal(size=(300, 8))
frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
rows = ann.search(frame, 20, k=5, sample=200, parts=8).collect()
print("ROWS", len(rows), len({{r.query_id for r in rows}}))
"""


def test_routing_needs_no_package_on_the_executors(tmp_path):
    """A driver that alone can import the package, in a folder of its own."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", ROUTED.format(repo=str(Path(__file__).resolve().parents[2]))],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 75 15" in done.stdout, done.stderr[-2000:]


def plain_features(text):
    import re

    import xxhash

    one, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1
    two = 0xC2B2AE3D27D4EB4F
    words = re.findall(r"[^\W\d_]+", text.lower())
    h = [xxhash.xxh64_intdigest(w.encode(), toxicity.SEED) for w in words]
    grams = list(h) + [xxhash.xxh64_intdigest(w[:4].encode(), toxicity.SEED + 1) for w in words]
    grams += [(a * one + b) * two & mask for a, b in zip(h, h[1:], strict=False)]
    grams += [((a * two + b) * one & mask) ^ two for a, b in zip(h, h[2:], strict=False)]
    return sorted({((g ^ g >> 29) * two & mask) >> 64 - toxicity.BITS for g in grams})


def test_learner_equals_a_plain_one():
    """Features and the FTRL update, coordinate by coordinate, against plain Python."""
    rng = np.random.default_rng(2)
    words = ["Bad", "nasty", "fine", "kind", "Ärger", "day"]
    rows = [(" ".join(rng.choice(words, 9)), int(i % 3 == 0)) for i in range(40)]
    known = toxicity._Words(), toxicity._Words(toxicity.STEM)
    model, z, n = toxicity.Ftrl(), {}, {}

    def weight(i):
        l1 = 0 if i == toxicity.BIAS else toxicity.L1
        if abs(z.get(i, 0)) <= l1:
            return 0.0
        return (np.sign(z[i]) * l1 - z[i]) / ((toxicity.BETA + np.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for text, label in rows * 3:
        found = toxicity.features(text, known)
        assert found.tolist() == plain_features(text)
        model.learn(found, label)
        at = [*found.tolist(), toxicity.BIAS]
        w = {i: weight(i) for i in at}
        g = 1 / (1 + np.exp(-sum(w.values()))) - label
        for i in at:
            s = (np.sqrt(n.get(i, 0) + g * g) - np.sqrt(n.get(i, 0))) / toxicity.ALPHA
            z[i] = z.get(i, 0) + g - s * w[i]
            n[i] = n.get(i, 0) + g * g
    got = model.weights(np.arange(toxicity.BIAS + 1))
    assert np.flatnonzero(got).tolist() == sorted(i for i in z if weight(i))
    assert all(abs(got[i] - weight(i)) < 1e-9 for i in z)


def test_cut_leaves_clean_rows_below():
    """The intercept of a sample with few toxic rows: hardly a clean row above it."""
    rng = np.random.default_rng(4)

    def rows(special, n=1500):
        out = []
        for i in range(n):
            y = int(i % 10 == 0)
            f = set(rng.integers(100, 3000, 40).tolist()) | (set(rng.integers(0, 8, special).tolist()) if y else set())
            out.append((np.array(sorted(f), np.int32), y))
        return out

    def shares(sample):
        at, w = toxicity._train(sample)
        dense = np.zeros(toxicity.BIAS + 1)
        dense[at] = w
        sums = np.array([dense[toxicity.BIAS] + dense[f].sum() for f, _ in sample])
        label = np.array([y for _, y in sample])
        return (sums[label == 0] >= 0).mean(), (sums[label == 1] >= 0).mean()

    clean, toxic = shares(rows(4))
    assert clean <= 0.01 and toxic >= 0.9
    # Nothing to learn, or one class: the cut stays where it is.
    assert toxicity._cut([(np.array([1], np.int32), i % 2) for i in range(60)]) == 0.0
    assert toxicity._cut([(f, 1) for f, _ in rows(1, 9)]) == 0.0
