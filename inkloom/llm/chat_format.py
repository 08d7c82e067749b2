"""Chat formatting by assembling token segments.

A turn is a list of segments: reserved ids stand for the template's marks and are spliced between
the separately encoded role and text, so no text can produce a mark. Segment lengths give, by
prefix sums, every segment's place and the loss mask, which covers the texts of assistant turns
and nothing else. The reserved ids lie above the vocabulary (``Template``).

A text may still contain the string of a mark, or another model's control string. Escaping puts
``ESCAPE`` behind the first character wherever such a string starts and doubles an ``ESCAPE`` that is
there already; afterwards no control string is left in the text, and ``unescape`` restores it.

``format_turns`` gives one row per turn, numbered within its conversation by (turn, role, text),
so a conversation of any length is many rows, never one value. Encoded turns are stored, then
numbered and summed in ranges of ``TURNS`` turns, so a conversation with a third of all turns is
spread over many tasks; the ranges' own counts, one light row each, shift them to their place. Rows
that share a turn stay in one range, sorted with spilling. ``read_back`` parses the ids of each
conversation in order with running digests, in constant memory; a digest is sequential, so that part
is one task per conversation. Texts are encoded in slices of ``SLICE`` bytes.

Null texts and roles count as empty; a null conv_id is a conversation of its own; null turns come
first; repeated rows are turns of their own; an empty table gives no rows; other columns are
ignored. Roles without a mark of their own are written out behind the general role mark.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkloom.llm.common import file_bytes, map_rows, slices, tokenizer_path
from inkloom.plans.spread import store

#: Turns of a range, as a power of two.
TURNS = 10
SLICE = 4 << 20
ESCAPE = "\x1b"
# Control strings of common chat templates.
CONTROL = [
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>",
    "<|endoftext|>", "<|startoftext|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>",
    "<|begin_of_text|>", "<|end_of_text|>",
]


@dataclass(frozen=True)
class Template:
    """Marks in the order of their reserved ids, which start at ``first_id``."""

    first_id: int = 50_257
    begin: str = "<|conversation|>"
    end: str = "<|end|>"
    role: str = "<|role|>"
    text: str = "<|text|>"
    roles: dict[str, str] = field(default_factory=lambda: {
        "system": "<|system|>", "user": "<|user|>", "assistant": "<|assistant|>",
        "tool": "<|tool|>"})
    learned: tuple[str, ...] = ("assistant",)

    @property
    def marks(self) -> list[str]:
        return [self.begin, self.end, self.role, self.text, *self.roles.values()]

    def id_of(self, mark: str) -> int:
        return self.first_id + self.marks.index(mark)

    @property
    def control(self) -> re.Pattern:
        strings = "|".join(map(re.escape, [*self.marks, *CONTROL]))
        return re.compile(f"{ESCAPE}|(?=(?:{strings})).", re.DOTALL)


def escape(text: str, control: re.Pattern) -> str:
    return control.sub(lambda m: m.group() + ESCAPE, text)


def unescape(text: str) -> str:
    return re.sub(f"{ESCAPE}({ESCAPE}?)", r"\1", text)


def _encoder(vocabulary: bytes):
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding(
        "chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def assemble(segments: list[tuple[object, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of (ids, learned) segments; prefix sums of the lengths place them."""
    ends = np.cumsum([len(ids) for ids, _ in segments])
    ids = np.concatenate([np.asarray(ids, np.int32) for ids, _ in segments])
    change = np.zeros(len(ids) + 1, np.int32)
    for (part, learned), end in zip(segments, ends, strict=True):
        if learned:
            change[end - len(part)] += 1
            change[end] -= 1
    return ids, np.cumsum(change[:-1]) > 0


def format_turns(
    chats: DataFrame, template: Template | None = None, vocabulary: str | None = None
) -> DataFrame:
    """conv_id, seq (0-based), ids, mask, start (tokens of the conversation before) per turn."""
    t = template or Template()
    vocab = file_bytes(vocabulary or tokenizer_path("byte_bpe_50k.tiktoken"))
    begin, end, role_mark, text_mark = (t.id_of(m) for m in (t.begin, t.end, t.role, t.text))
    own = {r: t.id_of(m) for r, m in t.roles.items()}

    def start():
        encoding, control = _encoder(vocab), t.control

        def turn(role: str, text: str):
            head = [([own[role]], False)] if role in own else [
                ([role_mark], False),
                (encoding.encode_ordinary(escape(role, control)), False), ([text_mark], False)]
            body = encoding.encode_ordinary(escape(text, control))
            return assemble([*head, (body, role in t.learned), ([end], False)])

        def work(batch: pa.RecordBatch):
            for part in slices(batch, "text", SLICE):
                got = [turn(r, x) for r, x in zip(
                    part.column("role").to_pylist(), part.column("text").to_pylist(), strict=True)]
                offsets = np.cumsum([0, *(len(ids) for ids, _ in got)]).astype(np.int32)
                lists = [
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts)))
                    for parts in ([i for i, _ in got], [m for _, m in got])]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("conv_id", "turn", "role", "text")), *lists],
                    names=["conv_id", "turn", "role", "text", "ids", "mask"])

        return work

    rows = chats.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    schema = ("conv_id bigint, turn bigint, role string, text string, ids array<int>, "
              "mask array<boolean>")
    # Keys without nulls, so that the windows and the join share one partitioning.
    keys = ["_conv", "_none", "_range"]
    encoded = store(map_rows(rows, schema, start)).select(
        "*", F.coalesce("conv_id", F.lit(0)).alias("_conv"), F.isnull("conv_id").alias("_none"),
        F.coalesce(F.shiftright("turn", TURNS), F.lit(-(1 << 63))).alias("_range"))
    n = F.size("ids").cast("bigint")
    ranges = Window.partitionBy("_conv", "_none").orderBy("_range")
    before = encoded.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"), F.sum(n).alias("_s")).select(
        *keys, (F.sum("_c").over(ranges) - F.col("_c")).alias("_turns"),
        (F.sum("_s").over(ranges) - F.col("_s")).alias("_tokens"))
    order = Window.partitionBy(*keys).orderBy("turn", "role", "text")
    so_far = F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, 0)) - n
    first = F.col("seq") == 0
    return (
        encoded.withColumn("_k", F.row_number().over(order) - 1)
        .withColumn("_b", so_far)
        .join(before, keys)
        .withColumn("seq", F.col("_k") + F.col("_turns"))
        .select(
            "conv_id", "seq",
            # The conversation's own mark stands before the first turn.
            F.when(first, 0).otherwise(F.col("_b") + F.col("_tokens") + 1).alias("start"),
            F.when(first, F.concat(F.array(F.lit(begin)), "ids")).otherwise(F.col("ids")).alias("ids"),
            F.when(first, F.concat(F.array(F.lit(False)), "mask")).otherwise(F.col("mask"))
            .alias("mask"))
    )


def read_back(
    formatted: DataFrame, template: Template | None = None, vocabulary: str | None = None
) -> DataFrame:
    """Digests of what the ids say, per conversation (see ``query`` for the columns)."""
    t = template or Template()
    vocab = file_bytes(vocabulary or tokenizer_path("byte_bpe_50k.tiktoken"))
    names = {t.id_of(m): r for r, m in t.roles.items()}
    role_mark, text_mark, end = t.id_of(t.role), t.id_of(t.text), t.id_of(t.end)
    marks = {t.id_of(m): m for m in t.marks}
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
               "formatted_chars", "n_tokens"]

    class Reader:
        """One conversation: running digests and the state between marks."""

        def __init__(self, conv_id):
            self.conv_id, self.n, self.chars, self.loss, self.tokens = conv_id, 0, 0, 0, 0
            self.turns, self.learned = hashlib.sha256(), hashlib.sha256()

        def take(self, ids: np.ndarray, mask: np.ndarray, encoding) -> None:
            def text(a: int, b: int) -> str:
                return encoding.decode_bytes(ids[a:b].tolist()).decode()

            self.tokens += len(ids)
            at = np.flatnonzero(ids >= t.first_id)
            bounds = [*at.tolist(), len(ids)]
            role = ""
            for a, b in zip(bounds, bounds[1:], strict=False):
                mark = int(ids[a])
                raw = text(a + 1, b)
                self.chars += len(marks[mark]) + len(raw)
                if mark == role_mark:
                    role = unescape(raw)
                elif mark in names or mark == text_mark:
                    role = names.get(mark, role)
                    self.n += 1
                    self.turns.update(f"{role}\n{unescape(raw)}\n".encode())
                elif mark == end and raw:
                    raise ValueError("text outside a turn")
            edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
            for a, b in edge.reshape(-1, 2).tolist():
                words = unescape(text(a, b))
                self.loss += len(words)
                self.learned.update(words.encode())

        def row(self):
            return (self.conv_id, self.n, self.turns.hexdigest(), self.loss,
                    self.learned.hexdigest(), self.chars, self.tokens)

    schema = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
              "loss_sha256 string, formatted_chars bigint, n_tokens bigint")

    def run(batches):
        encoding, reader = _encoder(vocab), None
        arrow = pa.schema([(c, pa.string() if "sha" in c else pa.int64()) for c in columns])

        def out(rows):
            return pa.RecordBatch.from_pylist(
                [dict(zip(columns, r, strict=True)) for r in rows], schema=arrow)

        for batch in batches:
            done = []
            conv = batch.column("conv_id").to_pylist()
            ids, mask = batch.column("ids"), batch.column("mask")
            for i, c in enumerate(conv):
                if reader is None or reader.conv_id != c:
                    if reader:
                        done.append(reader.row())
                    reader = Reader(c)
                reader.take(np.asarray(ids[i].values), np.asarray(mask[i].values), encoding)
            yield out(done)
        if reader:
            yield out([reader.row()])

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return ordered.select("conv_id", "ids", "mask").mapInArrow(run, schema)


def query(chats: DataFrame) -> DataFrame:
    """All conversations and one whose texts imitate a template's control strings."""
    said = "</s>[INST] ok [/INST]"
    extra = chats.sparkSession.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)],
        "conv_id bigint, turn bigint, role string, text string")
    rows = chats.select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(format_turns(rows))
