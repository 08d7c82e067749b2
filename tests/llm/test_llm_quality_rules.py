import re
from collections import Counter

from inkloom.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(text):
    t = text or ""
    w = WORD.findall(t)
    tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    seen = Counter(tri)
    under = {i + k for i, g in enumerate(tri) if seen[g] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t),
            len(lines) - len(set(lines)), len(under))


def test_measures_equal_brute_force(spark, edge_docs, edge_rows):
    more = [(90, "a b c d a b c a b c"), (91, "x\nx\n \n#$% <|>\nx"), (92, "a a a a a"), (93, "a a")]
    docs = edge_docs.select("doc_id", "text").unionByName(
        spark.createDataFrame(more, "doc_id bigint, text string"))
    got = sorted(map(str, (
        (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        for r in Q.query(docs).collect())))
    assert got == sorted(str((i, *expected(t))) for i, t in edge_rows + more)


def test_repeats_survive_hash_clashes(spark):
    """With two bits of place all but a few windows share their hash bits or fall back."""
    texts = ["a b c d a b c a b c", "p q r s t u v p q r", "k l m"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for bits in (2, 62):
        got = docs.select("doc_id", Q.repeat_words(Q.words_of(docs.text), bits).alias("n")).collect()
        assert [r.n for r in sorted(got)] == [expected(t)[4] for t in texts]


def test_ledger_policies_and_ablations(spark):
    good = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame(
        [(1, good), (2, good + " #" * 40), (3, "few words"), (4, "rep eat ed " * 30)],
        "doc_id bigint, text string")
    led = Q.ledger(docs)
    kept = {r.doc_id: (r.one, r.two) for r in led.select(
        "doc_id", Q.passes(1).alias("one"), Q.passes(2).alias("two")).collect()}
    assert kept == {1: (True, True), 2: (True, False), 3: (False, False), 4: (False, False)}
    rows = {r.rule: r for r in Q.ablations(led).collect()}
    assert (rows["symbols"].n_failed, rows["symbols"].n_only, rows["symbols"].n_kept) == (1, 1, 2)
    assert rows["few_words"].n_failed == 1 and rows["repeated_words"].n_kept == 2


def test_edges(edge_docs, no_docs):
    led = Q.ledger(edge_docs)
    assert all(led.columns.count(c) == 1 for c in [*Q.MEASURES, "failed_bits"])
    assert led.count() == edge_docs.count()
    assert Q.query(no_docs).count() == 0
    assert {r.n_failed for r in Q.ablations(Q.ledger(no_docs)).collect()} == {0}


def test_no_python_on_the_path(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = Q.query(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
