import itertools
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from compare import rows_of
from tokenizers import Tokenizer

import corpus_pipeline as P
from inkloom.llm import catalog, suffix_dedup, toxicity
from inkloom.llm.quality_rules import query as rules
from inkloom.plans.spread import shared_dir, store

from test_llm_others import plain_features

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(catalog.sql()[name])
    names = [d[0] for d in cursor.description]
    df = catalog.queries()[name](spark, SF)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, cursor.fetchall())


def test_stages(spark):
    """Each stage's decisions, from its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, seen = docs, []
    for name, stage in P.STAGES:
        after = store(stage(spark, before, SF))
        seen.append((name, before, after))
        before = after
    assert [n for n, _, _ in seen] == [
        "toxicity", "quality rules", "SimHash near-dedup", "suffix-array dedup", "best-fit packing"]
    assert all(a.columns == docs.columns for _, _, a in seen[:-1])
    _, b, a = seen[0]
    at, w = toxicity.fit(b, spark.read.parquet(f"{SF}/labels.parquet"))
    weight = dict(zip(at.tolist(), w.tolist(), strict=True))
    sums = {r.doc_id: weight.get(toxicity.BIAS, 0.0) + sum(weight.get(f, 0.0) for f in plain_features(r.text or ""))
            for r in b.collect()}
    assert all(abs(v) > 1e-4 for v in sums.values())  # no score so near the cut that rounding decides
    assert {r.doc_id for r in a.collect()} == {i for i, v in sums.items() if v < 0} and a.count() < b.count()
    _, b, a = seen[1]
    assert {r.doc_id for r in a.collect()} == {r.doc_id for r in rules(b).filter("kept").collect()}
    _, b, a = seen[2]
    assert a.exceptAll(b).count() == 0
    assert {r.doc_id for r in a.collect()} == firsts({r.doc_id: r.text or "" for r in b.collect()})
    assert a.count() < b.count()
    _, b, a = seen[3]
    assert a.count() == b.count()
    assert suffix_dedup.repeated_spans(a, 2 * P.PASSAGE, "first").count() == 0
    assert a.filter("n_chars <> length(text)").count() == 0
    _, b, a = seen[4]
    check_packing({r.doc_id: r.text or "" for r in b.collect()}, a.collect())


def firsts(texts):
    """The smallest id of every component of texts whose sets of five-word shingles are 0.8 alike."""
    sets = {}
    for i, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {" ".join(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(sorted(texts), 2):
        a, b = sets[i], sets[j]
        if a == b or len(a & b) >= 0.8 * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {find(i) for i in texts}


def check_packing(texts, rows):
    """Pieces from ids of the tokenizer's own file, gapless sequences, and as few as there can be."""
    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        tokenizer = Tokenizer.from_str(f.read())
    want = set()
    for i, t in texts.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        want |= {(i, p, a, b - a, zlib.crc32(ids[a:b].tobytes()))
                 for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))}
    assert {tuple(r)[:5] for r in rows} == want and len(rows) == len(want)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(by) == -(-sum(r.length for r in rows) // 2048)


def test_run_leaves_its_result_alone(spark):
    """What stages store, and the stages before the last, are gone after the run."""
    folder = Path("/" + shared_dir(spark).removeprefix("file:").lstrip("/"))

    def tables():
        return {f.name for f in folder.iterdir() if f.name.startswith(("stage", "stored", "scratch", "numbered"))}

    before = tables()
    rows = P.run(spark, SF)
    assert rows.count() and len(tables() - before) == 1
    assert rows.select("sequence_id").count() > 0


def test_stages_on_edges(spark, edge_docs, no_docs):
    def as_documents(df):
        return df.select("doc_id", "text").selectExpr(
            "*", "CAST(NULL AS STRING) AS lang", "'s' AS source", "0L AS n_chars", "'x' AS node")

    for docs in (as_documents(edge_docs), as_documents(no_docs)):
        for _, stage in P.STAGES:
            stage(spark, docs, SF).count()
