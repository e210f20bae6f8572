"""Token counts, token shards and the piece codec against their libraries."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest

from wagerlens.llm import bpe_count as B
from wagerlens.llm import piece_codec as C
from wagerlens.llm import token_shards as S

BPE, RANKS, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def strange_texts():
    draw = random.Random(3)
    letters = " \t\n\r\u3000\xa0\x85\x1c'sdlvemretheain.,!0129\u00f1\u00e9\u00c4\u00df\u6f22\u5b57\u200b\U0001f600\u0301\u2177\u00b2<|>="
    return ["".join(draw.choice(letters) for _ in range(draw.randint(0, 60))) for _ in range(3000)] + [" " * 70, "ab" * 900, "<|endoftext|> a<|endoftext|><|endoftext|>"]


def test_counts_match_the_library(strange_texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    count = B.counter(B.read_merges(BPE))
    assert [count(x) for x in strange_texts] == [len(e.ids) for e in library.encode_batch(strange_texts, add_special_tokens=False)]


def test_memo_is_bounded_and_right():
    memo = B.Memo(len, entries=4, longest=3)
    for _ in range(3):
        assert [memo["a" * n] for n in range(20)] == list(range(20))
        assert [memo[f"{n}"] for n in range(90)] == [len(f"{n}") for n in range(90)]
        assert len(memo) <= 4 and len(memo.older) <= 4


def test_count_frame(documents, odd_rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    found = sorted(map(tuple, B.count_tokens(documents(odd_rows), BPE, limit=10).collect()), key=str)
    wanted = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t, _ in odd_rows]
    assert found == sorted(((i, len((t or "").encode()), n, n > 10) for (i, t, _), n in zip(odd_rows, wanted)), key=str)
    assert B.count_tokens(documents([]), BPE).count() == 0


def test_registered_counts(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: r.n_tokens for r in B.op6_token_counts(spark, "/root/testdata/sf0.001").collect()}
    assert found == {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) for r in rows}


def test_pieces_match_the_library(strange_texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids = C.encoder(C.read_pieces(PIECES))
    texts = [*strange_texts, "thethethe" * 300, "<s>a</s>"]
    assert [np.frombuffer(ids(x), np.int32).tolist() for x in texts] == [library.encode(x) for x in texts]


def piece_model(path, pieces, kind, byte_pieces):
    """A model file of given (piece, score) and kind, written out by hand; nothing is trained."""

    def field(number, value):
        if isinstance(value, int):
            return bytes([number << 3, value])
        if isinstance(value, float):
            return bytes([number << 3 | 5]) + np.float32(value).tobytes()
        size, head = len(value), b""
        while size >= 0x80:
            head, size = head + bytes([size & 0x7F | 0x80]), size >> 7
        return bytes([number << 3 | 2]) + head + bytes([size]) + value

    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] * byte_pieces + [(p, s, 1) for p, s in pieces]
    body = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, t)) for p, s, t in rows)
    body += field(2, field(3, kind) + (bytes([35 << 3 & 0x7F | 0x80, 35 << 3 >> 7, 1]) if byte_pieces else b""))
    body += field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1))
    path.write_bytes(body)
    return str(path)


def score_pieces(seed, step):
    """Pieces over a few letters; scores are multiples of ``step``, so that many paths tie."""
    draw = random.Random(seed)
    pieces = {"".join(draw.choice("▁abcdé") for _ in range(draw.randint(1, 7))) for _ in range(150)} | set("▁abcd")
    return [(p, -step * draw.randint(1, 40) * len(p) ** 0.5 if step < 0.5 else -step * draw.randint(1, 12)) for p in sorted(pieces)]


@pytest.mark.parametrize("byte_pieces", [False, True])
@pytest.mark.parametrize("step", [0.37, 1.0])
def test_scored_pieces_match_the_library(tmp_path, strange_texts, step, byte_pieces):
    """Unigram models: sums that tie, unknown characters, pieces with marks inside, long texts in which sums are rounded."""
    import sentencepiece

    path = piece_model(tmp_path / "unigram.model", score_pieces(int(step * 9), step), 1, byte_pieces)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = C.encoder(C.read_pieces(path))
    draw = random.Random(4)
    texts = ["".join(draw.choice(" aabbccddéx") for _ in range(draw.randint(0, 90))) for _ in range(2000)] + strange_texts[:300] + ["abcd" * 9000, "xy  z" * 50, "".join(draw.choice("ab cdé") for _ in range(60_000))]
    assert [np.frombuffer(ids(x), np.int32).tolist() for x in texts] == [library.encode(x) for x in texts]


def test_the_window_of_scores_stays_small(tmp_path):
    pieces = C.read_pieces(piece_model(tmp_path / "m.model", score_pieces(3, 0.37), 1, False))
    lattice, draw = C.ScoreLattice(pieces), random.Random(5)
    parts = list(lattice.committed("".join(draw.choice("▁abcdé") for _ in range(20_000))))
    assert len(parts) > 100 and max(len(part) for part in parts) < 20 * pieces.longest


def test_scored_frames(documents, odd_rows, tmp_path):
    import sentencepiece

    path = piece_model(tmp_path / "u.model", score_pieces(3, 0.37), 1, True)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    found = C.encode_pieces(documents(odd_rows), path).collect()
    assert sorted(((r.doc_id, r.ids) for r in found), key=str) == sorted(((i, library.encode(t or "")) for i, t, _ in odd_rows), key=str)
    assert all(r.round_trip for r in C.round_trips(documents(odd_rows), path).collect())


def test_other_models_are_refused(tmp_path):
    with pytest.raises(ValueError, match="only unigram and BPE"):
        C.read_pieces(piece_model(tmp_path / "w.model", score_pieces(3, 1.0), 3, False))


def test_the_window_stays_small():
    """On a text without a cut the search commits as it goes, and what it commits is the whole encoding."""
    import sentencepiece

    pieces = C.read_pieces(PIECES)
    text = "".join(random.Random(2).choice(["the", "ing", "er", "tion", "x", "q"]) for _ in range(5000))
    lattice = C.Lattice(pieces)
    parts = list(lattice.committed(text))
    assert len(parts) > 100 and max(sum(len(lattice.units[unit]) for unit, _ in part) for part in parts) < 40 * pieces.longest
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    whole = np.frombuffer(C.encoder(pieces)(text), np.int32).tolist()
    assert whole == library.encode(text)


def test_codec_frames(documents, odd_rows):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = documents(odd_rows)
    encoded = C.encode_pieces(docs, PIECES)
    assert sorted(((r.doc_id, r.ids) for r in encoded.collect()), key=str) == sorted(((i, library.encode(t or "")) for i, t, _ in odd_rows), key=str)
    decoded = C.decode_pieces(encoded, PIECES).collect()
    assert all(r.decoded == (r.text or "") == library.decode(r.ids) for r in decoded)
    assert all(r.round_trip for r in C.round_trips(docs, PIECES).collect())
    assert C.round_trips(documents([]), PIECES).count() == 0


def test_decoding_broken_bytes(spark):
    pieces = C.read_pieces(PIECES)
    rows = [([pieces.byte_ids[0xC3]],), (None,), ([],), ([pieces.ids["▁a"], pieces.byte_ids[0xC3], pieces.byte_ids[0xA9]],)]
    frame = spark.createDataFrame(rows, "ids array<int>")
    assert [r.decoded for r in C.decode_pieces(frame, PIECES, keep=("ids",)).collect()] == ["\ufffd", "", "", "aé"]


@pytest.mark.parametrize("count", [1, 2, 3, 7, 64, 1000, 4097])
def test_feistel_is_a_permutation(count):
    one, other = S.feistel(np.arange(count), count, key=1), S.feistel(np.arange(count), count, key=2)
    assert sorted(one) == sorted(other) == list(range(count))
    assert count < 60 or list(one) != list(other)
    assert list(S.feistel(np.array([count - 1, 0]), count, key=1)) == [one[-1], one[0]]


def test_shards_round_trip(spark, documents, odd_rows, tmp_path):
    import tiktoken

    ranks = S.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = documents(odd_rows).coalesce(2)
    manifest, total = S.write_shards(docs, RANKS, str(tmp_path / "s"), length=64, per_shard=50)
    manifest = manifest.collect()
    assert total == len(manifest)
    assert sorted(r.slot for r in manifest) == sorted(r.sequence for r in manifest) == list(range(total))
    body = {r.slot: r for r in S.read_slots(spark, str(tmp_path / "s"), 0, total, 64, 50).collect()}
    assert len(body) == total and all(r.shard == s // 50 and r.offset == s % 50 * 129 for s, r in body.items())
    stream = np.concatenate([np.frombuffer(body[r.slot].body, np.uint16)[: r.n_tokens] for r in sorted(manifest, key=lambda r: r.sequence)])
    texts = [r.text or "" for r in docs.select("text").collect()]
    assert stream.tolist() == [i for t in texts for i in [*library.encode_ordinary(t), len(ranks)]]
    resumed = {r.slot for r in S.read_slots(spark, str(tmp_path / "s"), 45, 60, 64, 50).collect()}
    assert resumed == set(range(45, min(60, total)))
    owners = {i for r in manifest for i in r.doc_ids}
    assert owners == {i for i, _, _ in odd_rows}
    again = S.write_shards(docs, RANKS, str(tmp_path / "t"), length=64, per_shard=50)[0].collect()
    assert sorted(map(str, again)) == sorted(map(str, manifest))


def test_ids_of_any_type(spark, tmp_path):
    """Ids are kept as they are, and a group of sequences is split over many shards."""
    docs = spark.createDataFrame([(k, "some words here " * k) for k in range(1, 40)], "k int, text string").selectExpr("date_add(date'2020-01-01', k) as d", "cast(k as decimal(9,2)) as m", "encode(text, 'utf-8') as b", "text")
    for name, values in (("d", 39), ("m", 39), ("b", 39)):
        manifest, count = S.write_shards(docs, RANKS, str(tmp_path / name), length=16, per_shard=7, id_column=name)
        assert len({str(i) for r in manifest.collect() for i in r.doc_ids}) == values
        assert S.read_slots(spark, str(tmp_path / name), 0, count, 16, 7).count() == count > 100


def test_shards_of_nothing(documents, tmp_path):
    manifest, total = S.write_shards(documents([]), RANKS, str(tmp_path / "s"))
    assert manifest.count() == total == 0


def test_ids_match_the_library(strange_texts):
    import tiktoken

    ranks = S.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    write = S.id_writer(ranks)
    texts = [*strange_texts, " a b", "a b ", "a\nb c", "a b\n", " "]
    assert [np.frombuffer(write(x), np.uint16).tolist() for x in texts] == [library.encode_ordinary(x) for x in texts]


def test_registered_shards(spark):
    rows = S.op7_token_shards(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows))) and all(r.crc is not None for r in rows)
