"""Byte-level BPE by compatible neighbours, held against the rank file's own library and a plain merge loop."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

from loadkit.llm import bpe


@pytest.fixture(scope="module")
def encoder():
    return bpe.make_encoder()


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(),
                             special_tokens={})


def merge_loop(ranks: dict[bytes, int], piece: bytes) -> list[int]:
    parts = [piece[k:k + 1] for k in range(len(piece))]
    while len(parts) > 1:
        rank, k = min((ranks.get(parts[k] + parts[k + 1], 1 << 30), k) for k in range(len(parts) - 1))
        if rank == 1 << 30:
            break
        parts[k:k + 2] = [parts[k] + parts[k + 1]]
    return [ranks[p] for p in parts]


def random_vocabulary(rng: random.Random, size: int) -> dict[bytes, int]:
    """Ranks by merges of random adjacent tokens, so that many tokens come apart in several ways."""
    ranks = {bytes([b]): b for b in range(256)}
    letters = [b"a", b"b", b"c"]
    while len(ranks) < 256 + size:
        piece = b"".join(rng.choices(letters, k=rng.randint(2, 9)))
        parts = [next(t for t, r in ranks.items() if r == i) for i in merge_loop(ranks, piece)]
        if len(parts) > 1:
            k = rng.randrange(len(parts) - 1)
            ranks.setdefault(parts[k] + parts[k + 1], len(ranks))
    return ranks


def test_any_vocabulary_gives_the_merge_loops_tokens():
    rng = random.Random(9)
    for _ in range(25):
        ranks = random_vocabulary(rng, rng.choice([3, 10, 40]))
        own = bpe.Encoder(ranks, r"\S+|\s+")
        for _ in range(120):
            piece = b"".join(rng.choices([b"a", b"b", b"c"], k=rng.randint(1, 40)))
            expected = [ranks[piece]] if piece in ranks else merge_loop(ranks, piece)
            assert list(own.piece_ids(piece)) == expected


def test_texts_as_the_library_does(encoder, library, doc_rows):
    rng = random.Random(3)
    letters = "aAbé😀 \n\t'stre漢字がнет12,.  \x1c\x85　"
    texts = [r[1] or "" for r in doc_rows] + ["".join(rng.choices(letters, k=rng.randint(0, 80))) for _ in range(800)]
    texts += ["".join(rng.choices("abcdeth", k=400)) for _ in range(50)] + ["a" * 5000, "xq" * 3000, "漢字" * 2000]
    texts += [f"a{chr(c)}b {chr(c)}" for c in [*range(0x300), 0x1680, 0x2028, 0x202F, 0xFEFF, 0x1F600]]
    for text in texts:
        ids = encoder.ids(text)
        assert list(ids) == library.encode_ordinary(text)
        assert encoder.decode(ids) == text.encode()


def test_chunks_and_blocks_do_not_show(encoder, library, monkeypatch):
    rng = random.Random(5)
    text = " ".join("".join(rng.choices("thein ao", k=rng.randint(1, 300))) for _ in range(60)) + "  \n x"
    expected = library.encode_ordinary(text)
    monkeypatch.setattr(bpe, "CHUNK", 50)
    monkeypatch.setattr(bpe, "BLOCK", 7)
    assert list(encoder.ids(text)) == expected


def test_memory_of_pairs_and_pieces_is_bounded(encoder, library, monkeypatch):
    monkeypatch.setattr(bpe, "PAIRS", 3)
    monkeypatch.setattr(bpe, "PIECES", 2)
    own = bpe.Encoder(bpe.read_ranks(), public_tokenizers.PATTERN)
    text = "unbelievable antidisestablishment qzxv, qzxv unbelievable wordwordword"
    assert list(own.ids(text)) == library.encode_ordinary(text)
    assert len(own.merges.known) <= 3 and len(own.pieces) <= 2


def test_ranks_that_merges_cannot_give_are_refused():
    ranks = {bytes([b]): b for b in range(256)}
    with pytest.raises(ValueError, match="not made by merges"):
        bpe.Merges(ranks | {b"abc": 256})
    with pytest.raises(ValueError, match="no token"):
        bpe.Merges({b"a": 0})


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_report_and_round_trip(spark, docs, doc_rows, library):
    got = Counter(tuple(r) for r in bpe.encoding_report(docs).collect())
    expected = Counter()
    for doc_id, text, *_ in doc_rows:
        ids = library.encode_ordinary(text or "")
        expected[doc_id, len(ids), sha(",".join(map(str, ids)).encode()), sha((text or "").encode())] += 1
    assert got == expected
    back = Counter((r.doc_id, r.text) for r in bpe.decode_ids(bpe.encode_texts(docs)).collect())
    assert back == Counter((r[0], r[1] or "") for r in doc_rows)


def test_empty_table(no_docs):
    assert bpe.encoding_report(no_docs).collect() == []
    assert bpe.decode_ids(bpe.encode_texts(no_docs)).collect() == []
