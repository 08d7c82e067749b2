"""Removal of long repeated passages by suffix arrays and longest previous factors.

A byte goes if it lies in a string of ``length`` bytes that starts a second time anywhere in the corpus
(``keep="none"``), or started before, in the order of (doc_id, text hash, place) (``keep="first"``, which leaves the
first copy). Texts are UTF-8 bytes; strings never cross documents and are judged on the input.

How the corpus is cut for it, exactly:

1. Every start of a string belongs to the smallest hash among the ``gram``-byte strings inside it
   (the leftmost of equals). That depends on the string alone, so equal strings belong to equal anchors,
   and starts with one anchor form a run of about ``length - gram`` / 2. One row per run.
2. Anchors whose hash occurs once have no repeats. Among the others, runs with equal text (a
   128-bit hash) are counted before anything is shipped: copies of a passage, however many, are
   one class with one representative.
3. Groups of one anchor hash with several classes need the order of their suffixes. The texts of
   the representatives meet in a task, in the order of the corpus; prefix doubling sorts the suffixes at
   all starts by their first ``length`` bytes, equal ones by place. Common prefixes of neighbours in suffix
   order follow from the ranks of the doubling steps; the previous and next smaller positions in that order
   then give every start its longest previous factor, up to ``length`` (the larger ones its longest
   next factor). Starts whose factor has ``length`` bytes are repeats.
4. A group beyond ``GROUP_BYTES`` is not sorted in one task: its starts are dealt by a 128-bit
   hash of their string and counted, which gives the same answer at any size.

Documents are addressed by (doc_id, 64-bit text hash), so repeated rows need no numbering: they
count as two documents, so ``keep="none"`` removes what they share, and as one document under ``keep="first"``,
where rows that cannot be told apart keep their text together. Null texts are empty, null doc_ids come first, texts
shorter than ``length`` keep everything, very long texts are cut into overlapping chunks whose
runs fit together, an empty table gives no rows, and other columns are kept by ``dedup`` and play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.llm.common import id_or_least, map_rows, slices, text_hash
from inkloom.plans.spread import store

LENGTH = 400
# Sorting takes some 70 bytes a byte, in every core's worker at once.
GROUP_BYTES = 1 << 20
BATCH_BYTES = 1 << 19
SLICE = 1 << 20
_PLACE_BITS = 22
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15


def gram_of(length: int) -> int:
    """Largest power of two up to two fifths of ``length``."""
    return 1 << max(0, int(length * 2 // 5).bit_length() - 1)


def _gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """Mixed 64-bit hash of the ``gram`` bytes from each place on."""
    h, n = b.astype(np.uint64) + np.uint64(1), 1
    while n < gram:
        h = h[:-n] * np.uint64(pow(_BASE, n, 1 << 64)) + h[n:]
        n *= 2
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def anchor_runs(b: np.ndarray, ends: np.ndarray, length: int):
    """Runs of starts with one anchor in texts laid end to end: text number, first start (in
    ``b``), number of starts, anchor hash. ``ends`` are the texts' ends in ``b``."""
    gram = gram_of(length)
    none = np.zeros(0, np.int64)
    if len(b) < length:
        return none, none, none, none.astype(np.uint64)
    h = _gram_hashes(b, gram)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, n = length - gram + 1, 1
    while 2 * n <= width:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    if n < width:
        least = np.minimum(least[:n - width], least[width - n:])
    owner = (least & low).astype(np.int64)
    places = np.arange(len(owner))
    text = np.searchsorted(ends, places, side="right")
    fits = np.flatnonzero(places + length <= ends[text])
    if not len(fits):
        return none, none, none, none.astype(np.uint64)
    new = np.ones(len(fits), bool)
    new[1:] = (owner[fits[1:]] != owner[fits[:-1]]) | (text[fits[1:]] != text[fits[:-1]])
    at = np.flatnonzero(new)
    first = fits[at]
    return text[first], first, np.diff(np.append(at, len(fits))), h[owner[first]]


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(id_or_least().alias("d"), text_hash().alias("th"), F.coalesce("text", F.lit("")).alias("text"))


def runs(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """h, w1, w2, d, th, lo, n: anchor hash, hash of the run's text, document, first start, and
    number of starts of every run."""
    names = ["h", "w1", "w2", "d", "th", "lo", "n"]

    def start():
        import xxhash

        def work(batch: pa.RecordBatch):
            for part in slices(batch, "text", SLICE):
                chunks, of, base = [], [], []
                for i, t in enumerate(part.column("text").to_pylist()):
                    raw = t.encode()
                    for c in range(0, max(1, len(raw) - length + 1), CHUNK):
                        chunks.append(raw[c:c + CHUNK + length - 1])
                        of.append(i)
                        base.append(c)
                yield from pack_runs(part, chunks, np.array(of), np.array(base))

        def pack_runs(part, chunks, of, base):
            at = 0
            while at < len(chunks):
                n, size = at, 0
                while n < len(chunks) and (n == at or size + len(chunks[n]) <= CHUNK):
                    size += len(chunks[n])
                    n += 1
                raw = b"".join(chunks[at:n])
                ends = np.cumsum([len(c) for c in chunks[at:n]])
                text, first, count, h = anchor_runs(np.frombuffer(raw, np.uint8), ends, length)
                w = b"".join([xxhash.xxh128_digest(raw[a:b]) for a, b in zip(
                    first.tolist(), (first + count + length - 1).tolist(), strict=True)])
                w = np.frombuffer(w, np.int64).reshape(-1, 2)
                begin = ends - [len(c) for c in chunks[at:n]]
                rows = pa.array(of[at:n][text])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(w[:, 0]), pa.array(w[:, 1]),
                     part.column("d").take(rows), part.column("th").take(rows),
                     pa.array(first - begin[text] + base[at:n][text]), pa.array(count)],
                    names=names)
                at = n

        return work

    return map_rows(_keyed(docs), ", ".join(f"{c} bigint" for c in names), start)


def _paired(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return first.astype(np.uint64) << np.uint64(32) | second


def _dense_ranks(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    k = keys[order]
    step = np.zeros(len(k), np.uint32)
    step[1:] = k[1:] != k[:-1]
    rank = np.empty(len(k), np.uint32)
    rank[order] = np.cumsum(step, dtype=np.uint32)
    return rank


def suffix_order(
    b: np.ndarray, starts: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of ``starts`` by their first ``length`` bytes, equal ones by place, and
    how many of these bytes each shares with the one before it (0 for the first). Prefix doubling."""
    top = 1 << (length.bit_length() - 1)
    n = min(8, top)
    padded = np.concatenate((b, np.zeros(n, np.uint8)))
    keys = np.zeros(len(b), np.uint64)
    for i in range(n):
        keys <<= np.uint64(8)
        keys |= padded[i:i + len(b)]
    rank = _dense_ranks(keys)
    levels = [(n, rank)]
    while n < top:
        ahead = np.zeros_like(rank)
        ahead[:-n] = rank[n:]
        rank = _dense_ranks(_paired(rank, ahead))
        n *= 2
        levels.append((n, rank))
    rank = _dense_ranks(_paired(rank[starts], rank[starts + (length - top)]))
    order = np.argsort(_paired(rank, np.arange(len(starts), dtype=np.uint32)))
    shared = np.zeros(len(starts), np.int32)
    same = np.flatnonzero(rank[order[1:]] == rank[order[:-1]]) + 1
    shared[same] = length
    live = np.flatnonzero(rank[order[1:]] != rank[order[:-1]]) + 1
    p, q = starts[order[live - 1]], starts[order[live]]
    common = np.zeros(len(live), np.int64)
    for size, ranks in reversed(levels):
        # A suffix that would reach beyond its string cannot go on, so indices stay inside it.
        fits = common + size <= length
        more = np.zeros(len(live), bool)
        more[fits] = ranks[p[fits] + common[fits]] == ranks[q[fits] + common[fits]]
        common[more] += size
    for _ in range(min(8, top) - 1):
        fits = common < length
        more = np.zeros(len(live), bool)
        more[fits] = b[p[fits] + common[fits]] == b[q[fits] + common[fits]]
        common[more] += 1
    shared[live] = common
    return order, shared


def _reach(places: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """For each entry of the suffix order the common prefix with the nearest entry before it whose
    place is smaller; ``shared`` is that of neighbours. Pointers skip larger places by doubling."""
    n = len(places)
    to, least = np.arange(n) - 1, shared.copy()
    live = np.arange(1, n)
    live = live[places[to[live]] > places[live]]
    while len(live):
        at = to[live]
        least[live] = np.minimum(least[live], least[at])
        to[live] = to[at]
        live = live[to[live] >= 0]
        live = live[places[to[live]] > places[live]]
    return np.where(to >= 0, least, 0)


def _factors(order: np.ndarray, shared: np.ndarray, later: bool) -> np.ndarray:
    places = -order if later else order
    behind = np.append(shared[1:], 0)
    out = np.empty(len(order), np.int32)
    out[order] = np.maximum(_reach(places, shared), _reach(places[::-1], behind[::-1])[::-1])
    return out


def factors(b: np.ndarray, starts: np.ndarray, length: int, later: bool = False) -> np.ndarray:
    """Longest previous factor of each of the ascending ``starts``, up to ``length`` bytes: the most
    that it shares with an earlier start. With ``later``, the same for later starts."""
    return _factors(*suffix_order(b, starts, length), later)


def repeated_starts(b: np.ndarray, starts: np.ndarray, length: int, keep: str) -> np.ndarray:
    """For ascending ``starts``: whether the longest previous factor (or, to keep nothing, the
    longest next one) has ``length`` bytes."""
    order, shared = suffix_order(b, starts, length)
    out = _factors(order, shared, False) >= length
    if keep == "none":
        out |= _factors(order, shared, True) >= length
    return out


def _sorted_spans(windows: DataFrame, length: int, keep: str) -> DataFrame:
    """d, th, lo, hi: repeated stretches in the representatives' windows."""
    def run(batches):
        held, size, last = [], 0, None

        def flush(rows):
            t = pa.Table.from_batches(rows).combine_chunks()
            t = t.take(pa.compute.sort_indices(
                t, sort_keys=[(c, "ascending") for c in ("d", "th", "lo")]))
            text = t.column("window").to_pylist()
            lens = np.fromiter(map(len, text), np.int64, len(text))
            begin = np.cumsum(lens) - lens
            n, lo = t.column("n").to_numpy(), t.column("lo").to_numpy()
            of = np.repeat(np.arange(len(n)), n)
            starts = begin[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            hit = repeated_starts(
                np.frombuffer(b"".join(text), np.uint8), starts, length, keep)
            at = np.flatnonzero(hit)
            if not len(at):
                return
            new = np.ones(len(at), bool)
            new[1:] = (np.diff(at) != 1) | (of[at[1:]] != of[at[:-1]])
            first = np.flatnonzero(new)
            run_of, a = of[at[first]], starts[at[first]]
            many = np.diff(np.append(first, len(at)))
            lo = lo[run_of] + a - begin[run_of]
            yield pa.RecordBatch.from_arrays(
                [t.column("d").take(pa.array(run_of)).combine_chunks(),
                 t.column("th").take(pa.array(run_of)).combine_chunks(),
                 pa.array(lo), pa.array(lo + many + length - 1)], names=["d", "th", "lo", "hi"])

        for batch in batches:
            h = batch.column("h").to_numpy()
            sizes = batch.column("n").to_numpy() + length - 1
            cuts = [0, *(np.flatnonzero(h[1:] != h[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if size >= BATCH_BYTES and h[a] != last:
                    yield from flush(held)
                    held, size = [], 0
                held.append(batch.slice(a, b - a))
                size += int(sizes[a:b].sum())
                last = h[a]
        if held:
            yield from flush(held)

    return (
        windows.repartition("h").sortWithinPartitions("h")
        .mapInArrow(run, "d bigint, th bigint, lo bigint, hi bigint"))


def _counted_spans(windows: DataFrame, length: int, keep: str) -> DataFrame:
    """The same for groups that are too large for one task: strings are counted by hash."""
    names = ["s1", "s2", "d", "th", "p"]

    def start():
        import xxhash

        def work(batch: pa.RecordBatch):
            for part in slices(batch, "window", 1 << 18):
                n = part.column("n").to_numpy()
                s = b"".join([
                    xxhash.xxh128_digest(w[i:i + length])
                    for w, c in zip(part.column("window").to_pylist(), n.tolist(), strict=True)
                    for i in range(c)])
                s = np.frombuffer(s, np.int64).reshape(-1, 2)
                of = np.repeat(np.arange(len(n)), n)
                p = part.column("lo").to_numpy()[of] + np.arange(len(of)) - np.repeat(
                    np.cumsum(n) - n, n)
                rows = pa.array(of)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s[:, 0]), pa.array(s[:, 1]), part.column("d").take(rows),
                     part.column("th").take(rows), pa.array(p)], names=names)

        return work

    strings = store(map_rows(windows.select("d", "th", "lo", "n", "window"),
                             ", ".join(f"{c} bigint" for c in names), start))
    counts = strings.groupBy("s1", "s2").agg(
        F.count(F.lit(1)).alias("c"), F.min(F.struct("d", "th", "p")).alias("first"))
    found = strings.join(counts.filter("c > 1"), ["s1", "s2"])
    if keep == "first":
        found = found.filter(F.struct("d", "th", "p") != F.col("first"))
    return found.select("d", "th", F.col("p").alias("lo"), (F.col("p") + length).alias("hi"))


def repeated_spans(
    docs: DataFrame, length: int = LENGTH, keep: str = "none", group_bytes: int = GROUP_BYTES
) -> DataFrame:
    """d, th, spans: ascending, overlapping spans of bytes to remove, per document with any."""
    all_runs = store(runs(docs, length))
    # Stored, so that the join does not lean on the sums' partitions and a frequent anchor is split.
    again = store(
        all_runs.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h"))
    some = store(all_runs.join(again, "h"))
    text = ["h", "w1", "w2"]
    classes = store(some.groupBy(*text).agg(
        F.count(F.lit(1)).alias("c"), F.min("n").alias("n"),
        F.min(F.struct("d", "th", "lo")).alias("first")))
    copies = some.join(classes.filter("c > 1").select(*text, "first"), text)
    if keep == "first":
        copies = copies.filter(F.struct("d", "th", "lo") != F.col("first"))
    spans = copies.select("d", "th", "lo", (F.col("lo") + F.col("n") + length - 1).alias("hi"))

    groups = store(classes.groupBy("h").agg(
        F.count(F.lit(1)).alias("m"), F.sum(F.col("n") + length - 1).alias("size"))
        .filter("m > 1").select("h", (F.col("size") > group_bytes).alias("large")))
    wanted = (
        classes.join(groups, "h").select("first.d", "first.th", F.struct(
            "h", F.col("first.lo").alias("lo"), "n", "large").alias("run"))
        .groupBy("d", "th").agg(F.collect_list("run").alias("runs")))
    texts = _keyed(docs).groupBy("d", "th").agg(F.first("text").alias("text"))

    def start():
        def work(batch: pa.RecordBatch):
            for part in slices(batch, "text", SLICE):
                asked = part.column("runs").to_pylist()
                texts_ = [t.encode() for t in part.column("text").to_pylist()]
                of = pa.array([i for i, rs in enumerate(asked) for _ in rs])
                rows = [r for rs in asked for r in rs]
                windows = [texts_[i][r["lo"]:r["lo"] + r["n"] + length - 1]
                           for i, rs in enumerate(asked) for r in rs]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["h"] for r in rows]), part.column("d").take(of),
                     part.column("th").take(of), pa.array([r["lo"] for r in rows]),
                     pa.array([r["n"] for r in rows]), pa.array([r["large"] for r in rows]),
                     pa.array(windows, pa.binary())],
                    names=["h", "d", "th", "lo", "n", "large", "window"])

        return work

    windows = map_rows(
        texts.join(wanted, ["d", "th"]),
        "h bigint, d bigint, th bigint, lo bigint, n bigint, large boolean, window binary", start)
    if groups.filter("large").isEmpty():
        spans = spans.unionByName(_sorted_spans(windows, length, keep))
    else:
        windows = store(windows)
        spans = spans.unionByName(_sorted_spans(windows.filter("not large"), length, keep))
        spans = spans.unionByName(_counted_spans(windows.filter("large"), length, keep))
    return store(
        spans.distinct().groupBy("d", "th")
        .agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans")))


def merge(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal removed stretches of sorted spans."""
    out: list[list[int]] = []
    for s in spans:
        if out and s["lo"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["hi"])
        else:
            out.append([s["lo"], s["hi"]])
    return [(a, b) for a, b in out]


def cut_text(raw: bytes, gone: list[tuple[int, int]], whole_chars: bool = False) -> bytes:
    """What is left of ``raw``; with ``whole_chars``, a character that is cut stays whole."""
    out, at = [], 0
    for a, b in gone:
        if whole_chars:
            while a < b and raw[a] & 0xC0 == 0x80:
                a += 1
            while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                b -= 1
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def _with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    keyed = docs.withColumn("_d", id_or_least()).withColumn("_th", text_hash())
    renamed = spans.select(F.col("d").alias("_d"), F.col("th").alias("_th"),
                           F.col("spans").alias("_spans"))
    return keyed.join(renamed, ["_d", "_th"], "left").drop("_d", "_th")


def dedup(docs: DataFrame, length: int = LENGTH, keep: str = "first") -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``, on whole characters."""
    fields = docs.schema.fields
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def start():
        def work(batch: pa.RecordBatch):
            for part in slices(batch, "text", SLICE):
                texts = [
                    t if not s else cut_text(t.encode(), merge(s), True).decode()
                    for t, s in zip(part.column("text").to_pylist(),
                                    part.column("_spans").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(texts, pa.string()) if f.name == "text" else part.column(f.name)
                     for f in fields], names=[f.name for f in fields])

        return work

    spans = repeated_spans(docs, length, keep)
    joined = _with_spans(docs, spans)
    return map_rows(joined.select(*[f"`{f.name}`" for f in fields], "_spans"), schema, start)


def query(docs: DataFrame) -> DataFrame:
    """The digest per document, and its remaining text (cut characters as U+FFFD)."""
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))

    def start():
        def work(batch: pa.RecordBatch):
            for part in slices(batch, "text", SLICE):
                out = []
                for t, s in zip(part.column("text").to_pylist(),
                                part.column("_spans").to_pylist(), strict=True):
                    raw, gone = t.encode(), merge(s or [])
                    left = cut_text(raw, gone)
                    out.append((len(raw), len(raw) - len(left), len(gone),
                                hashlib.sha256(left).hexdigest(), left.decode(errors="replace")))
                columns = [pa.array(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *columns],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

        return work

    return map_rows(
        _with_spans(rows, repeated_spans(rows, LENGTH, "none")),
        "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, text string",
        start)
