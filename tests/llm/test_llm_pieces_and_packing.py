import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from inkloom.llm import packing, piece_nbest

WORDS = ["hello wo", "  the cat", "a\nb ▁x", "aaaaaaa", "über ñ", "汉\u0001z", " x ", "in the"]


@pytest.fixture(scope="module")
def pieces():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return piece_nbest.Pieces(f.read())


def every_path(pieces, text):
    into, _ = pieces.lattice(f" {text}")
    out = []

    def back(at, score, ids):
        if not at:
            out.append((score, ids))
        for i, s, found in into[at] if at else ():
            back(i, score + s, found + ids)

    back(len(text) + 1, 0, ())
    return out


@pytest.mark.parametrize("text", WORDS)
def test_n_best_equals_all_paths(pieces, text):
    paths = every_path(pieces, text)
    for n in (1, 4, 7):
        got = piece_nbest.Encoder(pieces, n).encode(text)
        best = sorted((s for s, _ in paths), reverse=True)[:n]
        assert [s for s, _ in got] == best
        assert [s for s, _ in pieces.search(f" {text}", n)] == best
        assert len({tuple(i) for _, i in got}) == len(got)
        assert {(s, tuple(i.tolist())) for s, i in got} <= set(paths)


def test_side_by_side_equals_one_by_one(pieces):
    rng = random.Random(6)
    chunks = [f" {w}" for w in WORDS] + ["x", "\u0001", "  ", "\n", "▁", "汉字", " ab\u0001c\U0001f600"]
    chunks += ["".join(rng.choice("aeionrst\u0002é汉") for _ in range(rng.randint(1, 30))) for _ in range(200)]
    best, loss, sizes, ids = pieces.two_best_of(chunks)
    at = 0
    for i, chunk in enumerate(chunks):
        assert (best[i], loss[i], tuple(ids[at:at + sizes[i]])) == pieces.two_best(chunk)
        at += sizes[i]


@pytest.fixture(scope="module")
def fractional():
    """The model with scores that are no whole numbers."""
    pb2 = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    proto = pb2.ModelProto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        proto.ParseFromString(f.read())
    for i, piece in enumerate(proto.pieces):
        if piece.type == 1:
            piece.score = -5 - (i * 7919 % 1000) / 300
    return piece_nbest.Pieces(proto.SerializeToString())


@pytest.mark.parametrize("text", WORDS[:5])
def test_fractional_scores_are_kept(fractional, text):
    paths = sorted((s for s, _ in every_path(fractional, text)), reverse=True)
    got = piece_nbest.Encoder(fractional, 5).encode(text)
    assert [s for s, _ in got] == pytest.approx(paths[:5], abs=1e-9)
    assert any(s != round(s) for s, _ in got)
    if len(paths) > 5 and paths[0] - paths[4] < 1:
        assert len({round(s) for s in paths[:5]}) < len(set(paths[:5]))


def test_long_chunk_and_forgetting(pieces, monkeypatch):
    monkeypatch.setattr(piece_nbest, "CACHED_CHUNKS", 2)
    text = "a" * 5000 + " b c d e b c d e " + " " * 900
    got = piece_nbest.Encoder(pieces, 4).encode(text)
    assert len(got) == 4
    assert all(piece_nbest.decode_ids(i.tolist(), pieces) == text for _, i in got)


def test_documents_come_back(edge_docs, edge_rows, no_docs):
    rows = piece_nbest.encode_nbest(edge_docs)
    back = piece_nbest.decode(rows.filter("rank = 1"), to="again").collect()
    assert sorted(map(str, ((r.doc_id, r.again) for r in back))) == sorted(
        str((i, t or "")) for i, t in edge_rows)
    for r in piece_nbest.query(edge_docs.filter("doc_id = 4")).collect():
        text = dict(edge_rows)[4]
        assert r.decoded_crc32 == zlib.crc32(text.encode())
    assert rows.filter("text IS NULL OR text = ''" if "text" in rows.columns else "n_pieces = 0"
                       ).filter("rank > 1").count() == 0
    assert piece_nbest.query(no_docs).count() == 0


def check_plan(counts, capacity):
    """All pieces placed once, sequences gapless and full at most; returns their number."""
    runs = packing.plan(counts, capacity)
    used, filled = {}, {}
    for n, (length, rank, first, per, offset) in enumerate(runs.tolist()):
        same = [r for r in runs.tolist() if r[0] == length]
        after = [r[1] for r in same if r[1] > rank]
        stop = min(after, default=counts[length])
        for i in range(stop - rank):
            key = first + i // per
            filled.setdefault(key, []).append((offset + i % per * length, length))
        used[length] = used.get(length, 0) + stop - rank
    assert used == {k: v for k, v in counts.items() if v}
    for parts in filled.values():
        parts.sort()
        assert parts[0][0] == 0 and sum(parts[-1]) <= capacity
        assert all(a + b == c for (a, b), (c, _) in zip(parts, parts[1:], strict=False))
    return len(filled)


def test_plans():
    rng = random.Random(1)
    for _ in range(60):
        capacity = rng.choice([7, 20, 64])
        counts = {n: rng.randint(0, 30) for n in range(1, capacity + 1) if rng.random() < 0.5}
        made = check_plan(counts, capacity)
        # Best-fit decreasing, document by document, needs as many.
        room = []
        for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
            fit = min((r for r in room if r >= n), default=None)
            if fit is None:
                room.append(capacity - n)
            else:
                room[room.index(fit)] -= n
        assert made == len(room)
    assert len(packing.plan({}, 8)) == 0


def test_packing_edges(edge_docs, edge_rows, no_docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
           for _, t in edge_rows]
    rows = packing.query(edge_docs).collect()
    want = []
    for (doc, _), x in zip(edge_rows, ids, strict=True):
        cuts = [0, *range(len(x) % 2048 or 2048, len(x), 2048), len(x)]
        want += [(doc, p, a, b - a, zlib.crc32(x[a:b].tobytes()))
                 for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in rows)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and sum(parts[-1]) <= 2048
        assert all(a + b == c for (a, b), (c, _) in zip(parts, parts[1:], strict=False))
    assert packing.query(no_docs).count() == 0


def test_both_readers_of_the_vocabulary_agree():
    files = [open(public_tokenizers.path(f"byte_bpe_50k.{k}"), "rb").read()
             for k in ("tiktoken", "json")]
    encode = packing._encoder(*files)
    tokenizer = Tokenizer.from_buffer(files[1])
    rng = random.Random(5)
    alphabet = "ab '\n\t\r\x00 ́é汉🙂١Ⅷ²ſ,.<|endoftext|>"
    for text in ["<|endoftext|>", " <|endoftext|> x", "a" * 3000, " " * 300, "it's 'll"] + [
            "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(400)]:
        assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
