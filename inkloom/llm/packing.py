"""Best-fit packing planned on the histogram of piece lengths.

Documents become token ids with one end id each; only those above the capacity are cut, into
pieces of full capacity behind a first piece that takes the rest. The plan needs no documents: best-fit
decreasing runs over (length, count) and moves whole groups of sequences with the same room left.
Its result is a list of runs, each saying where the pieces of one length with ranks a .. b go. A
piece then finds its sequence and offset by its rank within its length.

Size of the plan: filling a group of room R with pieces of length L leaves less than R / 2, so a
group is filled at most log2(capacity) times, and each length starts at most three groups. For 2048
tokens that is below 80,000 runs for any corpus, so runs are broadcast.

Ranks without a task per length: each task counts its pieces by length while it writes them
(``part``, ``k``); the counts per (part, length) are summed along the parts. The pieces, without
their texts, are written to the shared folder first, so a lost executor cannot change ranks.

Token ids are those of the ``tokenizers`` file. The same vocabulary read by ``tiktoken`` gives the
same ids in a fifth of the time and is used for all texts without the end-of-text string, which
only the former reads as one id (tests compare both).

Null texts count as empty (a single end id); null and repeated doc_ids are kept as they are; an empty table
gives no rows; other columns are ignored. Ties between equal lengths go by rank, so which of two
equal-length pieces comes first is arbitrary but fixed once written.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkloom.llm.common import file_bytes, map_rows, tokenizer_path
from inkloom.plans.spread import store

CAPACITY = 2048
END_ID = 0
SPECIAL = "<|endoftext|>"


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs (length, first rank, first sequence, pieces per sequence, first offset), by length
    and rank. ``counts`` maps a length to its number of pieces."""
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: (first sequence, how many)
    runs, opened = [], 0
    for length in sorted((n for n, c in counts.items() if c > 0), reverse=True):
        left, rank, r = counts[length], 0, length
        while left:
            while r < capacity and not room[r]:
                r += 1
            per = r // length
            if not room[r]:  # r is the capacity: open as many as are needed
                room[r].append((opened, -(-left // per)))
                opened += -(-left // per)
            first, n = room[r].pop()
            full = min(n, left // per)
            if full:
                runs.append((length, rank, first, per, capacity - r))
                room[r - per * length].append((first, full))
                rank, left, first, n = rank + full * per, left - full * per, first + full, n - full
            if n and left:  # fewer pieces than one more sequence holds
                runs.append((length, rank, first, per, capacity - r))
                room[r - left * length].append((first, 1))
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            if n:
                room[r].append((first, n))
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def _encoder(tiktoken_file: bytes, tokenizers_file: bytes):
    """Function from text to a uint32 array of ids."""
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, tiktoken_file.splitlines())}
    quick = tiktoken.Encoding(
        "pack", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    full = []

    def encode(text: str) -> np.ndarray:
        if SPECIAL in text:
            full[:] = full or [Tokenizer.from_buffer(tokenizers_file)]
            return np.array(full[0].encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(quick.encode_ordinary(text), np.uint32)

    return encode


def pieces(docs: DataFrame, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and the task-wise rank (part, k) per piece, with
    ``ids`` if asked for."""
    files = [file_bytes(tokenizer_path(f"byte_bpe_50k.{k}")) for k in ("tiktoken", "json")]
    names = ["piece", "start", "length", "ids_crc32", "part", "k"]
    types = [pa.int32(), *[pa.int64()] * 5]

    def start():
        encode = _encoder(*files)
        part, seen = TaskContext.get().partitionId(), Counter()

        def work(batch: pa.RecordBatch):
            of, rows, kept = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(END_ID)).astype("<u4")
                cut = len(ids) - capacity * ((len(ids) - 1) // capacity)  # length of the first
                for p, (a, b) in enumerate(zip(
                        [0, *range(cut, len(ids), capacity)],
                        [*range(cut, len(ids), capacity), len(ids)], strict=True)):
                    own = ids[a:b]
                    rows.append((p, a, b - a, zlib.crc32(own.tobytes()), part, seen[b - a]))
                    seen[b - a] += 1
                    of.append(i)
                    if keep_ids:
                        kept.append(own.astype(np.int32))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(of)), *columns,
                 *([pa.array(kept, pa.list_(pa.int32()))] if keep_ids else [])],
                names=["doc_id", *names, *(["ids"] if keep_ids else [])])

        return work

    schema = ("doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, "
              "part bigint, k bigint" + (", ids array<int>" if keep_ids else ""))
    return map_rows(docs.select(F.col("doc_id").cast("bigint"), "text"), schema, start)


def pack(docs: DataFrame, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; see the module for the method."""
    cut = store(pieces(docs, capacity, keep_ids))
    along = Window.partitionBy("length").orderBy("part")
    counts = store(
        cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.sum("n").over(along) - F.col("n")))
    # At most ``capacity`` rows.
    lengths = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    runs = plan(lengths, capacity)
    sent = docs.sparkSession.sparkContext.broadcast((runs[:, 0] << 44 | runs[:, 1], runs))
    # A row per length and task: more with every task, so they are never broadcast.
    ranked = cut.join(counts.drop("n").hint("merge"), ["length", "part"]).withColumn(
        "rank", F.col("before") + F.col("k")).drop("part", "k", "before")

    def start():
        keys, table = sent.value

        def work(batch: pa.RecordBatch):
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            run = table[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            i = rank - run[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(run[:, 2] + i // run[:, 3]),
                 pa.array(run[:, 4] + i % run[:, 3] * length)],
                names=[*batch.schema.names[:-1], "sequence_id", "offset"])

        return work

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema[:-1]]
    return map_rows(ranked, ", ".join([*fields, "sequence_id bigint", "offset bigint"]), start)


def query(docs: DataFrame) -> DataFrame:
    return pack(docs).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
