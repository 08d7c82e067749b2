"""N-best segmentation into pieces, and back: forward Viterbi, then backward A-star.

The lattice of a text has a node between any two characters and an edge for every piece that
stands there. Forward Viterbi gives each node the score of its best path from the start. The
search then walks backwards from the end; the forward score of a node is exactly what the rest of
the way can bring, so paths leave the queue in order of their scores and the first n complete ones are
the n best.

Pieces hold blanks at their start only, so every lattice falls apart into chunks (blanks and what
follows them, or a line break); each chunk is searched once and remembered, and the n best of a
text are the n best sums over its chunks, of which only the n - 1 with the smallest first loss can
differ from their best. New chunks of many texts go through Viterbi side by side. The result equals that of one search over the whole lattice (tests do both).

Blanks are written as in the model (``▁`` with one in front of the text). A character that no piece
covers becomes its UTF-8 bytes' pieces at ``UNKNOWN`` each, below any piece, so decoding restores every text
exactly, a literal ``▁`` included. Scores are those of the model file. Segmentations of equal
score come in a fixed but unspecified order.

Null and empty texts have one segmentation, without pieces, of score 0. Texts are read whole; a
text with fewer segmentations than n gives that many rows. Rows are independent, repeated rows
repeat their result, other columns are ignored. Nothing is shuffled.
"""

from __future__ import annotations

import gc
import re
import sys
import zlib
from collections.abc import Iterator
from heapq import heappop, heappush, nsmallest
from itertools import chain
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.llm.common import file_bytes, map_rows, slices, tokenizer_path

N_BEST = 4
CACHED_CHUNKS = 400_000
_NEVER = float(-(1 << 60))
SLICE = 2 << 20
LONG_CHUNK, TOGETHER = 48, 40_000
_CHUNK = re.compile(r"\n|▁| *[^ \n▁]+| +")


class Pieces:
    """The pieces of a model by their text, with blanks for ``▁``."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ids: dict[str, tuple[int, int]] = {}
        self.bytes_of: list[bytes] = []
        self.byte_ids = [0] * 256
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                b = int(piece[3:5], 16)
                self.byte_ids[b] = i
                self.bytes_of.append(bytes([b]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                text = piece.replace("▁", " ")
                self.ids[text] = (i, sp.get_score(i))
                self.bytes_of.append(text.encode())
        self.unknown = min(s for _, s in self.ids.values() if s > -1e8) - 10
        # Every start of a piece: (score, ids) if it is a piece, else None.
        self.table = {t[:k]: None for t in self.ids for k in range(1, len(t) + 1)}
        self.table |= {t: (score, (i,)) for t, (i, score) in self.ids.items()}
        # The same as a tree: next character -> (its children, score and ids or None).
        nodes: dict[str, dict] = {"": {}}
        for t in sorted(self.table, key=len):
            nodes[t] = {}
            nodes[t[:-1]][t[-1]] = nodes[t], self.table[t]
        self.tree = nodes[""]
        self._number_nodes()

    def _number_nodes(self) -> None:
        """The tree as arrays: sorted (node, character) keys with the node that each leads to,
        and every node's piece."""
        number = {t: i for i, t in enumerate(sorted(self.table, key=len), 1)} | {"": 0}
        steps = sorted((number[t[:-1]] << 21 | ord(t[-1]), i) for t, i in number.items() if i)
        self.keys = np.array([k for k, _ in steps], np.int64)
        self.leads = np.array([i for _, i in steps], np.int64)
        self.node_id = np.full(len(number), -1, np.int64)
        self.node_score = np.zeros(len(number))
        for t, (i, score) in self.ids.items():
            self.node_id[number[t]], self.node_score[number[t]] = i, score

    def _edges(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Start, length, id and score of every piece in the chunks whose characters are ``codes``; id -1
        for a character without a piece, which stands for its bytes. ``ends``: of each character's chunk."""
        at, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        starts, nodes, lengths, single = [], [], [], np.zeros(len(codes), bool)
        size = 0
        while len(at):
            size += 1
            key = node << 21 | codes[at + size - 1]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[place] == key
            at, node = at[known], self.leads[place[known]]
            piece = self.node_id[node] >= 0
            starts.append(at[piece])
            nodes.append(node[piece])
            lengths.append(np.full(piece.sum(), size))
            if size == 1:
                single[at[piece]] = True
            inside = at + size < ends[at]
            at, node = at[inside], node[inside]
        bare = np.flatnonzero(~single)
        c = codes[bare]
        n_bytes = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
        nodes = np.concatenate(nodes)
        return (np.concatenate([*starts, bare]), np.concatenate([*lengths, np.ones(len(bare), np.int64)]),
                np.concatenate([self.node_id[nodes], np.full(len(bare), -1)]),
                np.concatenate([self.node_score[nodes], self.unknown * n_bytes]))

    def two_best_of(self, chunks: list[str]) -> tuple[np.ndarray, ...]:
        """``two_best`` of many chunks side by side, place by place: best scores, losses, numbers of
        pieces, and all their ids one after the other."""
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        begin = np.cumsum(sizes) - sizes
        chunk = np.repeat(np.arange(len(chunks)), sizes)
        codes = np.frombuffer("".join(chunks).encode("utf-32-le"), "<u4").astype(np.int64)
        start, size, ids, score = self._edges(codes, (begin + sizes)[chunk])
        place = start - begin[chunk[start]]
        # A chunk has a node before each character and one at its end.
        source = start + chunk[start]
        best, second = (np.full(len(codes) + len(chunks), _NEVER) for _ in range(2))
        best[begin + np.arange(len(chunks))] = 0.0
        back = np.full(len(best), -1)
        order = np.lexsort((size, place))
        step = place[order] << 21 | size[order]
        cuts = np.flatnonzero(np.diff(step)) + 1
        for edges in np.split(order, cuts):  # one start, one length: no node twice
            s = source[edges]
            t, x = s + size[edges], best[s] + score[edges]
            better = x > best[t]
            second[t] = np.maximum(np.where(better, best[t], second[t]),
                                   np.where(better, second[s] + score[edges], x))
            best[t] = np.where(better, x, best[t])
            back[t[better]] = edges[better]
        end = begin + sizes + np.arange(len(chunks))
        at, live, used = end.copy(), np.flatnonzero(sizes), []
        while len(live):
            edge = back[at[live]]
            used.append(edge)
            at[live] -= size[edge]
            live = live[place[edge] > 0]
        used = np.sort(start[np.concatenate(used)] << 32 | np.concatenate(used)) & 0xFFFFFFFF
        owner, found = chunk[start[used]], ids[used]
        if (found < 0).any():  # the bytes of characters without a piece
            listed = [(i,) if i >= 0 else tuple(self.byte_ids[b] for b in chr(c).encode())
                      for i, c in zip(found.tolist(), codes[start[used]].tolist(), strict=True)]
            owner = np.repeat(owner, list(map(len, listed)))
            found = np.fromiter(chain.from_iterable(listed), np.int64, len(owner))
        loss = np.where(second[end] > _NEVER / 2, best[end] - second[end], -_NEVER)
        return best[end], loss, np.bincount(owner, minlength=len(chunks)), found

    def lattice(self, text: str) -> tuple[list[list], list[float]]:
        """Edges (start, score, ids) into each node, and the forward Viterbi scores."""
        n, table = len(text), self.table
        into: list[list] = [[] for _ in range(n + 1)]
        best = [0.0] + [_NEVER] * n
        for i in range(n):
            here = best[i]
            if table.get(text[i]) is None:
                raw = text[i].encode()
                score = self.unknown * len(raw)
                into[i + 1].append((i, score, tuple(self.byte_ids[b] for b in raw)))
                best[i + 1] = max(best[i + 1], here + score)
            for j in range(i + 1, n + 1):
                found = table.get(text[i:j], 0)
                if found:
                    score, ids = found
                    into[j].append((i, score, ids))
                    if here + score > best[j]:
                        best[j] = here + score
                elif found == 0:
                    break
        return into, best

    def two_best(self, text: str) -> tuple[float, float, tuple[int, ...]]:
        """Best score, what the second best loses, and the best ids: forward Viterbi alone."""
        n, root = len(text), self.tree
        best, second = [0.0] + [_NEVER] * n, [_NEVER] * (n + 1)
        back: list = [None] * (n + 1)
        for i in range(n):
            b, c = best[i], second[i]
            step = root.get(text[i])
            if step is None or step[1] is None:  # no piece: the bytes of the character
                raw = text[i].encode()
                only = self.unknown * len(raw), tuple(self.byte_ids[x] for x in raw)
                step = {} if step is None else step[0], only
            j = i + 1
            while True:
                more, found = step
                if found is not None:
                    score, ids = found
                    x = b + score
                    if x > best[j]:
                        second[j] = best[j] if best[j] > c + score else c + score
                        best[j] = x
                        back[j] = i, ids
                    elif x > second[j]:
                        second[j] = x
                if j == n:
                    break
                step = more.get(text[j])
                if step is None:
                    break
                j += 1
        parts, at = [], n
        while at:
            at, ids = back[at]
            parts.append(ids)
        loss = best[n] - second[n] if second[n] > _NEVER // 2 else -_NEVER
        return best[n], loss, tuple(chain.from_iterable(reversed(parts)))

    def search(self, text: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best (score, ids) of a text, best first. Of equal scores, the path that has
        come furthest goes first, so ties do not widen the search."""
        into, best = self.lattice(text)
        queue = [(-best[-1], len(text), 0, 0, None)]
        out, pushed = [], 0
        while queue and len(out) < n:
            f, at, _, behind, path = heappop(queue)
            if not at:
                ids: list[int] = []
                while path:
                    ids.extend(path[0])
                    path = path[1]
                out.append((-f, tuple(ids)))
                continue
            for i, score, found in into[at]:
                pushed += 1
                heappush(queue, (-behind - score - best[i], i, pushed, behind + score, (found, path)))
        return out


class Chunks:
    """What Viterbi found for chunks, as columns by a chunk's number; all are forgotten, between
    slices of texts, when there are too many."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.raw: list[bytes] = []
        self.columns = [np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int32)]
        self.starts = np.zeros(0, np.int64)

    def learn(self, chunks: list[str]) -> None:
        """Viterbi for the chunks that are not known: side by side, very long ones one by one."""
        if len(self.number) >= CACHED_CHUNKS:
            self.forget()
        fresh = list({c for c, i in zip(chunks, map(self.number.get, chunks), strict=True) if i is None})
        if not fresh:
            return
        fresh.sort(key=len)
        short = sum(len(c) <= LONG_CHUNK for c in fresh)
        found = [self.pieces.two_best_of(fresh[a:min(a + TOGETHER, short)]) for a in range(0, short, TOGETHER)]
        for chunk in fresh[short:]:
            score, loss, ids = self.pieces.two_best(chunk)
            found.append(([score], [loss], [len(ids)], ids))
        new = [np.concatenate(c) for c in zip(*found, strict=True)]
        spelled, at = list(map(self.pieces.bytes_of.__getitem__, new[3].tolist())), 0
        for n in new[2].tolist():
            self.raw.append(b"".join(spelled[at:at + n]))
            at += n
        self.number.update(zip(fresh, range(len(self.number), len(self.number) + len(fresh)), strict=True))
        self.columns = [np.concatenate([c, f.astype(c.dtype)]) for c, f in zip(self.columns, new, strict=True)]
        self.starts = np.cumsum(self.columns[2]) - self.columns[2]

    def ids_of(self, i: int) -> tuple[int, ...]:
        return tuple(self.columns[3][self.starts[i]:self.starts[i] + self.columns[2][i]].tolist())


def chunks_of(text: str) -> list[str]:
    return _CHUNK.findall(f" {text}") if text else []


class Encoder:
    def __init__(self, pieces: Pieces, n: int):
        self.pieces, self.n, self.known = pieces, n, Chunks(pieces)
        self.lists: dict[str, list] = {}

    def others(self, chunk: str, chosen: int) -> list[tuple[float, tuple[int, ...]]]:
        """The next best (score, ids) of a chunk behind the one that Viterbi chose."""
        if len(self.lists) >= CACHED_CHUNKS // 20:
            self.lists.clear()
        if chunk not in self.lists:
            found, best = self.pieces.search(chunk, self.n), self.known.ids_of(chosen)
            self.lists[chunk] = [f for f in found if f[1] != best][: self.n - 1]
        return self.lists[chunk]

    def choices(self, texts: list[str]) -> Iterator[tuple[np.ndarray, list[bytes], list[tuple]]]:
        """For each text the ids of its best segmentation, the decoded bytes of its chunks, and of each of
        the n best its score and where it differs: (begin, end, chunk, other ids)."""
        split = list(map(chunks_of, texts))
        every = list(chain.from_iterable(split))
        known = self.known
        known.learn(every)
        number = np.fromiter(map(known.number.__getitem__, every), np.int64, len(every))
        score, loss, sizes, flat = known.columns
        score, loss, sizes = score[number], loss[number], sizes[number]
        ends = np.cumsum(sizes)
        ids = flat[np.repeat(known.starts[number] - (ends - sizes), sizes) + np.arange(sizes.sum())]
        raw = list(map(known.raw.__getitem__, number.tolist()))
        ends = np.append(0, ends)  # of the chunk before
        at = 0
        for chunks in split:
            a, at = at, at + len(chunks)
            if not chunks:
                yield ids[:0], [], [(0.0, [])]
                continue
            top, begin = float(score[a:at].sum()), ends[a]
            # The n - 1 chunks whose second best loses least; ties go to the earlier.
            sums: list[tuple[float, tuple]] = [(0.0, ())]
            for i in np.argsort(loss[a:at], kind="stable")[: self.n - 1].tolist():
                if loss[a + i] == -_NEVER:
                    break
                more = self.others(chunks[i], number[a + i])
                own = float(score[a + i])
                sums = nsmallest(self.n, chain(sums, (
                    (lost + own - s, (*choice, (i, other))) for lost, choice in sums for s, other in more)))
            yield ids[begin:ends[at]], raw[a:at], [
                (top - lost, [(int(ends[a + i] - begin), int(ends[a + i + 1] - begin), i, other)
                              for i, other in sorted(choice)])
                for lost, choice in sums]

    def encode(self, text: str) -> list[tuple[float, np.ndarray]]:
        """The n best (score, ids) of a whole text, best first."""
        best, _, found = next(self.choices([text]))
        return [(score, spliced(best, swaps)) for score, swaps in found]


def spliced(best: np.ndarray, swaps: list[tuple]) -> np.ndarray:
    """Ids with the stretches of ``swaps`` exchanged."""
    parts, at = [], 0
    for begin, end, _, other in swaps:
        parts += [best[at:begin], np.array(other, np.int32)]
        at = end
    return np.concatenate([*parts, best[at:]]) if parts else best


def shared_encoder(proto: bytes, n: int) -> Encoder:
    """The encoder of this model in this Python worker: what one task has learned about chunks
    serves the next ones as well. It holds a bounded number of chunks."""
    name = "piece_nbest_encoders"
    kept = vars(sys.modules.setdefault(name, ModuleType(name))).setdefault("kept", {})
    key = (zlib.crc32(proto), len(proto), n)
    if key not in kept:
        kept.clear()
        kept[key] = Encoder(Pieces(proto), n)
    return kept[key]


def decode_ids(ids: list[int], pieces: Pieces) -> str:
    """The text of a segmentation, without the blank in front."""
    return b"".join(map(pieces.bytes_of.__getitem__, ids))[1:].decode()


def encode_nbest(
    docs: DataFrame, n: int = N_BEST, keep_ids: bool = True, model: str | None = None
) -> DataFrame:
    """One row per document and segmentation: doc_id, rank (from 1), score, n_pieces,
    ids_crc32 (of little-endian 32-bit ids), decoded_crc32 (of the decoded text), and ``ids``."""
    proto = file_bytes(model or tokenizer_path("piece_bpe_32k.model"))
    names = ["rank", "score", "n_pieces", "ids_crc32", "decoded_crc32"]
    types = [pa.int32(), pa.float64(), *[pa.int64()] * 3]

    def start():
        # The remembered tuples form no cycles; searching them for some takes a fifth of the time.
        gc.set_threshold(1_000_000)
        encoder = shared_encoder(proto, n)
        pieces = encoder.pieces

        def work(batch: pa.RecordBatch):
            for part in slices(batch, "text", SLICE):
                of, rows, kept = [], [], []
                texts = [t or "" for t in part.column("text").to_pylist()]
                for i, (best, raw, found) in enumerate(encoder.choices(texts)):
                    for r, (score, swaps) in enumerate(found, 1):
                        ids, again = spliced(best, swaps), raw
                        if swaps:  # every piece is decoded; where two segmentations agree, once
                            again = raw.copy()
                            for _, _, c, other in swaps:
                                again[c] = b"".join(map(pieces.bytes_of.__getitem__, other))
                        rows.append((r, score, len(ids), zlib.crc32(ids.astype("<u4").tobytes()),
                                     zlib.crc32(b"".join(again)[1:])))
                        of.append(i)
                        if keep_ids:
                            kept.append(ids)
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(of)), *columns,
                     *([pa.array(kept, pa.list_(pa.int32()))] if keep_ids else [])],
                    names=["doc_id", *names, *(["ids"] if keep_ids else [])])

        return work

    schema = ("doc_id bigint, rank int, score double, n_pieces bigint, ids_crc32 bigint, "
              "decoded_crc32 bigint" + (", ids array<int>" if keep_ids else ""))
    return map_rows(docs.select(F.col("doc_id").cast("bigint"), "text"), schema, start)


def decode(rows: DataFrame, ids: str = "ids", to: str = "text", model: str | None = None) -> DataFrame:
    """``rows`` with the text of the array column ``ids`` in column ``to`` (null for null)."""
    proto = file_bytes(model or tokenizer_path("piece_bpe_32k.model"))
    kept = [c for c in rows.columns if c != to]

    def start():
        pieces = Pieces(proto)

        def work(batch: pa.RecordBatch):
            texts = [None if x is None else decode_ids(x, pieces)
                     for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, to])

        return work

    frame = rows.select(*[f"`{c}`" for c in kept])
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema]
    return map_rows(frame, ", ".join([*fields, f"`{to}` string"]), start)


def query(docs: DataFrame) -> DataFrame:
    return encode_nbest(docs, keep_ids=False)
