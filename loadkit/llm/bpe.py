"""Byte-level BPE encoding and decoding in linear time (operator 11).

A rank file gives each token a rank; the merge loop joins the adjacent pair
of lowest rank until none is left.  Its result needs no merge loop.  Every
token has one last merge, so it comes apart into a left and a right token in
one way, and a row of tokens is the merge loop's result exactly if each two
neighbours are compatible: taking both apart, no pair across their border
would have been merged before the pieces around it were.

Encoding walks through the text with the longest token at each place, found
by an Aho-Corasick automaton (``pyahocorasick``, bytes as Latin-1 letters) over
reversed tokens, so that all tokens that start at a place are found there.
A token that is not compatible with the one before it, or ends where
nothing can follow, gives way to its longest prefix that is a token; when
none is left the walk goes back one token and never comes to that place
again.  So every place is left at most once, and time is linear in the text.
Compatibility of a pair is memoised, and so are the ids of short pieces.

Pieces are the matches of a pattern, as the rank file's library splits
texts; a piece that is a token is taken as it is.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from loadkit.llm.lean import lean
from loadkit.llm.tokens import vocabulary_file

RANKS = "byte_bpe_multi_50k.tiktoken"
CHUNK = 1 << 16  # characters split into pieces at a time
BLOCK = 1 << 16  # places whose longest tokens are looked up at a time
PAIRS, PIECES, SHORT = 1 << 20, 1 << 19, 64  # memoised pairs; pieces, of at most so many characters


def read_ranks(name: str = RANKS) -> dict[bytes, int]:
    """Token bytes and their ranks: a line each, base 64 and a number."""
    with open(vocabulary_file(name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Merges:
    """How the tokens of a rank file come apart, and which may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token: dict[int, bytes] = {rank: token for token, rank in ranks.items()}
        if len(self.token) != len(ranks):
            raise ValueError("two tokens share a rank")
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"no token for the bytes {missing}")
        self.size = {rank: len(token) for rank, token in self.token.items()}
        self.above = max(self.token) + 1
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.known: dict[tuple[int, int], bool] = {}
        self.shorter = {rank: self._prefix(token) for rank, token in self.token.items()}
        for rank in sorted(self.token):
            self._take_apart(rank)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in ranks.items():
            self.automaton.add_word(token[::-1].decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.longest_token = max(self.size.values())

    def _prefix(self, token: bytes) -> int:
        """The longest token that ``token`` starts with, apart from itself; -1: none."""
        for n in range(len(token) - 1, 0, -1):
            found = self.ranks.get(token[:n])
            if found is not None:
                return found
        return -1

    def _take_apart(self, rank: int) -> None:
        """Find the last merge of a token among those of lower ranks."""
        token = self.token[rank]
        if len(token) == 1:
            return
        head = self.shorter[rank]
        while head >= 0:
            tail = self.ranks.get(token[self.size[head]:])
            if tail is not None and head < rank and tail < rank and self._side_by_side(head, tail):
                self.left[rank], self.right[rank] = head, tail
                self.joined[head, tail] = rank
                return
            head = self.shorter[head]
        # Merging its bytes would not give the token, or not in the order of ranks.
        raise ValueError(f"token {rank} is not made by merges of lower ranks")

    def _side_by_side(self, a: int, b: int) -> bool:
        """Whether the merge loop would leave ``a`` and ``b`` as neighbours.

        Undo merges from the last on: of the two tokens at the border the one
        of higher rank was made later (at equal ranks the left one was made
        first, as merges of one rank run from the left).  A pair across the
        border that has a lower rank than the merge undone would have come first.
        """
        undone, right_side = self.above, False
        while True:
            merged = self.joined.get((a, b))
            if merged is not None and (merged < undone or (right_side and merged == undone)):
                return False
            later_is_left = a > b
            if later_is_left and a in self.right:
                undone, right_side, a = a, False, self.right[a]
            elif not later_is_left and b in self.left:
                undone, right_side, b = b, True, self.left[b]
            elif a in self.right:
                undone, right_side, a = a, False, self.right[a]
            elif b in self.left:
                undone, right_side, b = b, True, self.left[b]
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        found = self.known.get((a, b))
        if found is None:
            if len(self.known) >= PAIRS:
                self.known.clear()
            found = self.known[a, b] = self._side_by_side(a, b)
        return found


class _Longest:
    """The longest token starting at each place of a piece, looked up in blocks; the last two are kept."""

    def __init__(self, merges: Merges, piece: bytes):
        self.merges, self.piece = merges, piece
        self.blocks: dict[int, array] = {}

    def __getitem__(self, at: int) -> int:
        number = at // BLOCK
        block = self.blocks.get(number)
        if block is None:
            while len(self.blocks) >= 2:
                del self.blocks[next(iter(self.blocks))]
            block = self.blocks[number] = self.block(number * BLOCK)
        return block[at - number * BLOCK]

    def block(self, start: int) -> array:
        # Tokens that start in the block may end beyond it.
        part = self.piece[start:start + BLOCK + self.merges.longest_token - 1]
        n, seen = len(part), -1
        out = array("i", bytes(4 * n))
        for end, rank in self.merges.automaton.iter(part[::-1].decode("latin-1")):
            if end != seen:  # matches with one end come longest first
                out[n - 1 - end], seen = rank, end
        return out


class Encoder:
    """Ids of texts and texts of ids under one rank file and splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.merges = merges = Merges(ranks)
        self.split = regex.compile(pattern).findall
        self.border = regex.compile(r"(?<=\S)\s").search
        short = self

        class Pieces(dict):
            def __missing__(self, piece: str):
                ids = short.piece_ids(piece.encode())
                if len(piece) <= SHORT:
                    ids = tuple(ids)
                    if len(self) >= PIECES:
                        self.clear()
                    self[piece] = ids
                return ids

        self.pieces = Pieces()
        self.names = {rank: str(rank) for rank in merges.token}

    def piece_ids(self, piece: bytes):
        """Ids of one piece: the only row of tokens in which all neighbours are compatible."""
        m = self.merges
        whole = m.ranks.get(piece)
        if whole is not None:
            return (whole,)
        n = len(piece)
        longest, size, shorter, compatible = _Longest(m, piece), m.size, m.shorter, m.compatible
        if n <= BLOCK:
            longest = longest.block(0)
        known = m.known
        closed = bytearray(n + 1)  # places from which the rest cannot be encoded
        out = [] if n <= BLOCK else array("I")
        at, token = 0, longest[0]
        while True:
            end = at + size[token]
            if not closed[end]:
                fits = True
                if out:
                    pair = out[-1], token
                    fits = known[pair] if pair in known else compatible(*pair)
                if fits:
                    out.append(token)
                    if end == n:
                        return out
                    at, token = end, longest[end]
                    continue
            token = shorter[token]
            while token < 0:
                closed[at] = 1
                token = out.pop()
                at -= size[token]
                token = shorter[token]

    def id_chunks(self, text: str) -> Iterator[list[int]]:
        """Ids of ``text``, in chunks cut where white space follows another character: no piece crosses such a place."""
        at = 0
        while at < len(text):
            cut = self.border(text, at + CHUNK) if at + CHUNK < len(text) else None
            end = cut.start() if cut else len(text)
            yield list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text, at, end))))
            at = end

    def ids(self, text: str | None) -> array:
        out = array("I")
        for chunk in self.id_chunks(text or ""):
            out.extend(chunk)
        return out

    def decode(self, ids) -> bytes:
        """The bytes of the tokens, in order; an id that is no token is a KeyError."""
        return b"".join(map(self.merges.token.__getitem__, ids))

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """(number of ids, digest of the decimal ids joined by commas, digest of the decoded bytes)."""
        count, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
        for ids in self.id_chunks(text or ""):
            if count:
                of_ids.update(b",")
            of_ids.update(",".join(map(self.names.__getitem__, ids)).encode())
            of_bytes.update(self.decode(ids))
            count += len(ids)
        return count, of_ids.hexdigest(), of_bytes.hexdigest()


def make_encoder(ranks: str = RANKS, pattern: str | None = None) -> Encoder:
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return Encoder(read_ranks(ranks), pattern)


def encode_texts(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", ranks: str = RANKS,
                 pattern: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) of every row of ``documents``.

    Null and empty texts have no ids; texts that are equal have equal ids;
    control strings in a text are ordinary text.  Rows with a null or repeated
    id are rows like others.  An empty table gives no rows; other columns are ignored.
    """
    @lean
    def run(batches):
        encoder = make_encoder(ranks, pattern)
        for batch in batches:
            for k in range(batch.num_rows):
                ids = pa.array(memoryview(encoder.ids(batch.column(1)[k].as_py())).cast("B").cast("i"), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(k, 1), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)],
                    names=["doc_id", "ids"])

    rows = documents.select(documents[id_column].cast("long").alias("doc_id"), documents[text_column].alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, *, ranks: str = RANKS) -> DataFrame:
    """``encoded`` (doc_id, ids) with the column text: the tokens' bytes read as UTF-8.

    A null row of ids gives a null text.  Bytes that are no UTF-8, which only
    ids that come from no text can give, are replaced by U+FFFD.
    """
    @lean
    def run(batches):
        token = {rank: token for token, rank in read_ranks(ranks).items()}
        for batch in batches:
            for k in range(batch.num_rows):
                ids = batch.column(1)[k].as_py()
                text = None if ids is None else b"".join(map(token.__getitem__, ids)).decode(errors="replace")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1),
                                                  pa.array([text], pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def encoding_report(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text",
                    ranks: str = RANKS, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of ``documents``: its ids, and their bytes read back.

    Cases as in ``encode_texts``; a text without ids has the digests of nothing.
    """
    @lean
    def run(batches):
        encoder = make_encoder(ranks, pattern)
        for batch in batches:
            made = [encoder.digest(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, t) for x, t in
                                    zip(zip(*made, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True))],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]) if made else batch.slice(0, 0)

    rows = documents.select(documents[id_column].cast("long").alias("doc_id"), documents[text_column].alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
