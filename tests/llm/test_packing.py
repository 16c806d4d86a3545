import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loadkit.llm.bfd_packing import RoomTree, best_fit_rows, pack_best_fit
from loadkit.llm.tier_packing import TIERS, pack_tiers, step_groups, tier_windows
from loadkit.llm.tokens import encode, encoder

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
TOKENIZER.encode_special_tokens = True


def ids_of(text, last):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [last]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_ids_are_the_tokenizers_own(text):
    assert encode(encoder(), text, 1).tolist() == ids_of(text, 1)


def test_ids_of_odd_texts():
    for text in ("<|endoftext|> x", " \n\n\t  a", "a" * 20000, " " * 20000, "İ ſ ǆ ٣ ４\x1c\x1d", "don't WE'LL"):
        assert encode(encoder(), text, 1).tolist() == ids_of(text, 1)


@given(st.lists(st.tuples(st.booleans(), st.integers(1, 30)), max_size=60))
def test_room_tree_finds_the_least_room(steps):
    tree, rooms = RoomTree(30), []
    for k, (add, n) in enumerate(steps):
        if add:
            tree.add(k, n)
            rooms.append(n)
        else:
            found = tree.take(n)
            want = min((r for r in rooms if r >= n), default=None)
            assert (found[1] if found else None) == want
            if found:
                rooms.remove(want)


def cover(pieces, lengths):
    """Every id of every item lies in exactly one piece."""
    own = {}
    for item, start, n in pieces:
        own.setdefault(item, []).append((start, n))
    for item, total in enumerate(lengths):
        at = 0
        for start, n in sorted(own.get(item, [])):
            assert start == at and n > 0
            at += n
        assert at == total


@given(st.lists(st.integers(1, 400), max_size=80))
def test_best_fit_rows(lengths):
    rows = best_fit_rows(lengths, 64)
    assert all(sum(n for _, _, n in row) <= 64 for row in rows)
    cover([p for row in rows for p in row], lengths)
    # A piece ends only at a multiple of the width or its document's end.
    assert all((s + n) % 64 == 0 or s + n == lengths[i] for row in rows for i, s, n in row)


@given(st.lists(st.integers(1, 400), max_size=80))
def test_tier_windows(lengths):
    windows = tier_windows(lengths, (8, 16, 32, 64))
    cover([p for _, own in windows for p in own], lengths)
    short = [t for t, own in windows if sum(n for _, _, n in own) != t]
    assert len(short) <= 1
    groups = step_groups(windows, 256)
    held = {}
    for g, (_, own) in zip(groups, windows, strict=True):
        held[g] = held.get(g, 0) + sum(n for _, _, n in own)
    if held:
        assert max(held.values()) - min(held.values()) <= 64


def test_best_fit_output_round_trip(docs, doc_rows):
    texts = {}
    for r in pack_best_fit(docs, block=6000).collect():
        line = np.frombuffer(r.ids, "<u2")
        place = np.frombuffer(r.positions, "<u2")
        assert len(line) == len(place) == 2048 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        assert (line[r.n_tokens:] == 50256).all()
        for k, (doc, start) in enumerate(zip(r.doc_ids, r.starts, strict=True)):
            a, b = r.cu_seqlens[k], r.cu_seqlens[k + 1]
            assert place[a:b].tolist() == list(range(b - a))
            texts.setdefault(doc, []).append((start, line[a:b].tolist()))
    want = {}
    for doc, text, *_ in doc_rows:
        want.setdefault(doc, []).extend(ids_of(text, 50256))
    assert texts.keys() == want.keys()
    for doc, own in texts.items():
        assert sorted(x for _, ids in own for x in ids) == sorted(want[doc])
    long = sorted(texts[305])
    assert [x for _, ids in long for x in ids] == want[305]


def test_tier_output(docs, doc_rows):
    rows = pack_tiers(docs, block=6000).collect()
    want = {}
    for doc, text, *_ in doc_rows:
        want.setdefault(doc, []).append(ids_of(text, 1))
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, r.tier))
        options = [ids for ids in want[r.doc_id] if len(ids) == r.doc_tokens]
        assert any(zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32
                   for ids in options)
    for pieces in sequences.values():
        at = 0
        for offset, n, tier in sorted(pieces):
            assert offset == at
            at += n
        assert at <= tier and tier in TIERS
    assert sum(r.length for r in rows) == sum(len(ids) for x in want.values() for ids in x)


def test_empty_tables(no_docs):
    assert pack_tiers(no_docs).count() == 0
    assert pack_best_fit(no_docs).count() == 0


def test_little_padding():
    rng = random.Random(2)
    lengths = [int(rng.expovariate(1 / 900)) + 1 for _ in range(3000)]
    assert sum(lengths) / (2048 * len(best_fit_rows(lengths, 2048))) > 0.98
