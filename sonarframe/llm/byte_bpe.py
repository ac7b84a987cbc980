"""Byte-level BPE encoding by a lazily determinised transducer, and streaming decoding.

A sequence of tokens is the BPE encoding of its bytes just when each pair of neighbours is: merging the
pair's bytes alone gives the pair back.  So every prefix of a text has one last token, and reading a byte
only asks which token that ends there fits the last token before it.  A state of the transducer is the last
emitted token and the bytes after it.  Where a token could still run over the end of what was read, the
encoding is open; the tokens that all such continuations share are emitted.  The bytes that wait are fewer
than a few token lengths.  States and transitions come into being when a text first needs them and are then
looked up.  The first KEPT transitions stay; later ones are kept beside them until there are LATER of those, when
they make room for others, also within a piece of text, where the state that has been reached is kept.  A new
transition makes one state and one verdict at most, so this bounds all tables.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

KEPT, LATER = 200_000, 50_000
#: Pieces that are remembered in a generation; there are two of them.
CACHED_PIECES = 75_000
#: With more tokens that go on from the waiting bytes than this, states are not merged.
LONGER = 48


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merged(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """BPE by its definition: merge the pair of the lowest rank, the leftmost first, until none has one."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts]


def halves(ranks: dict[bytes, int]) -> dict[int, tuple[int, int]]:
    """For each token of more than one byte, the two tokens whose merge makes it last."""
    out = {}
    for token, rank in ranks.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 2 and all(p in ranks for p in parts):
            out[rank] = (ranks[parts[0]], ranks[parts[1]])
    return out


class Transducer:
    def __init__(self, ranks: dict[bytes, int], half: dict[int, tuple[int, int]] | None = None):
        self.ranks = ranks
        self.token = {r: t for t, r in ranks.items()}
        self.half = halves(ranks) if half is None else half
        self.size = {r: len(t) for t, r in ranks.items()}
        extended: dict[bytes, list[int]] = {}
        for t, r in ranks.items():
            for k in range(1, len(t)):
                extended.setdefault(t[:k], []).append(r)
        self.prefixes = set(extended)
        self.longer = {p: tuple(x) for p, x in extended.items() if len(x) <= LONGER}
        self.reset()

    def reset(self) -> None:
        #: Last emitted token, bytes after it, last token of each prefix of those, where a token may still be open.
        self.states: list[tuple[int, bytes, tuple[int, ...], tuple[int, ...]]] = []
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.number: dict[tuple, int] = {}
        self.first = None  # the number of the first state that does not stay
        self._forget()
        self._state(-1, b"", (), (0,))

    def _forget(self) -> None:
        """Take out what does not stay."""
        if self.first is not None:
            del self.states[self.first :]
        self.later: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.new: dict[tuple, int] = {}
        self.verdicts: dict[tuple[int, bytes], int] = {}
        self.ends: dict[int, tuple[int, ...]] = {}

    def _state(self, before: int, pending: bytes, last: tuple[int, ...], live: tuple[int, ...]) -> int:
        """The state's number.  States that only differ in a last emitted token that no token to come is held against are one."""
        matters: object = before
        if live[0]:
            matters = None
        elif (longer := self.longer.get(pending)) is not None:
            key = (before, pending)
            matters = self.verdicts.get(key)
            if matters is None:
                matters = self.verdicts[key] = -2 - sum(self._pair(before, t) << k for k, t in enumerate(longer))
        found = (pending, last, matters)
        at = self.number.get(found)
        if at is None:
            at = self.new.get(found)
            if at is None:
                at = len(self.states)
                (self.number if self.first is None else self.new)[found] = at
                self.states.append((before, pending, last, live))
        return at

    def _pair(self, a: int, b: int) -> bool:
        """Whether b can follow a; a is -1 at the beginning.

        It can, unless some merge across the border would have come before the merges on either side that
        keep its parts from meeting.  So the border is followed downwards: of the two tokens at it, the one
        that was made last is taken apart, as both stood before that merge.
        """
        token, ranks, half = self.token, self.ranks, self.half
        made = 1 << 60  # the rank of the merge that has just been undone; one across has to come before it
        if b not in half and len(token[b]) > 1:
            return False
        while a >= 0:
            across = ranks.get(token[a] + token[b], made)
            if across < made:
                return False
            if a in half and (b not in half or a > b):
                made, a = a, half[a][1]
            elif b in half:
                made, b = b + 1, half[b][0]  # of equal ranks the left merge is first
            else:
                return True
        return True

    def _chain(self, last: tuple[int, ...], at: int) -> tuple[int, ...]:
        out = []
        while at:
            out.append(last[at - 1])
            at -= self.size[last[at - 1]]
        return tuple(out[::-1])

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        before, pending, last, open_at = self.states[state]
        pending += bytes([byte])
        n, live, found = len(pending), [], -1
        for j in open_at:
            run = pending[j:]
            if found < 0 and run in self.ranks and self._pair(last[j - 1] if j else before, self.ranks[run]):
                found = self.ranks[run]
            if run in self.prefixes:
                live.append(j)
        last += (found,)
        live.append(n)
        shared = n  # the last border that the encodings up to all open borders have in common
        for j in live:
            while j != shared:
                if j > shared:
                    j -= self.size[last[j - 1]]
                else:
                    shared -= self.size[last[shared - 1]]
        if not shared:
            return self._state(before, pending, last, tuple(live)), ()
        emitted = self._chain(last, shared)
        return self._state(emitted[-1], pending[shared:], last[shared:], tuple(j - shared for j in live)), emitted

    def _make(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """A transition that is not there yet."""
        if self.first is None:
            move = self.moves[state << 8 | byte] = self._move(state, byte)
            if len(self.moves) >= KEPT:
                self.first = len(self.states)
            return move
        if len(self.later) >= LATER:
            kept = self.states[state]
            self._forget()
            state = self._state(*kept)
        move = self.later[state << 8 | byte] = self._move(state, byte)
        return move

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """The tokens of one piece of text."""
        state, out, moves = 0, [], self.moves
        for b in piece:
            move = moves.get(state << 8 | b)
            if move is None:
                move = self.later.get(state << 8 | b) or self._make(state, b)
            state, emitted = move
            out += emitted
        if state not in self.ends:
            _, pending, last, _ = self.states[state]
            self.ends[state] = self._chain(last, len(pending))
        out += self.ends[state]
        return tuple(out)


#: A lead byte's number of following bytes and the range of the first of them; the others are 80 to BF.
_LEADS = {b: (1, 0x80, 0xBF) for b in range(0xC2, 0xE0)} | {b: (2, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF) for b in range(0xE0, 0xF0)} | {b: (3, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF) for b in range(0xF0, 0xF5)}


def utf8_step(pending: bytes, byte: int) -> tuple[str, bytes]:
    """(text, pending bytes) after one more byte; the pending bytes, at most three, are the state.

    Bytes that cannot be part of a character become U+FFFD, as in CPython's "replace" decoding.
    """
    if pending:
        need, low, high = _LEADS[pending[0]]
        low, high = (low, high) if len(pending) == 1 else (0x80, 0xBF)
        if low <= byte <= high:
            grown = pending + bytes([byte])
            return (grown.decode(), b"") if len(grown) == need + 1 else ("", grown)
        text, rest = utf8_step(b"", byte)
        return "�" + text, rest
    if byte < 0x80:
        return chr(byte), b""
    return ("", bytes([byte])) if byte in _LEADS else ("�", b"")


class Decoder:
    """Ids to text, as they come: a character is given out when its last byte is there."""

    def __init__(self, token: dict[int, bytes]):
        self.token = token
        self.pending = b""
        self.steps: dict[tuple[bytes, int], tuple[str, bytes]] = {}
        self.whole: dict[int, str] = {}

    def _step(self, pending: bytes, token: int) -> tuple[str, bytes]:
        text = []
        for b in self.token[token]:
            t, pending = utf8_step(pending, b)
            text.append(t)
        return "".join(text), pending

    def feed(self, ids: Iterable[int]) -> str:
        if not self.pending:  # as long as tokens are whole characters, the state stays the first one
            text = list(map(self.whole.get, ids))
            if None not in text:
                return "".join(text)
        out, pending, steps = [], self.pending, self.steps
        for i in ids:
            step = steps.get((pending, i))
            if step is None:
                step = steps[pending, i] = self._step(pending, i)
                if not pending and not step[1]:
                    self.whole[i] = step[0]
            text, pending = step
            out.append(text)
        self.pending = pending
        return "".join(out)

    def finish(self) -> str:
        rest, self.pending = "�" * bool(self.pending), b""
        return rest


class Tokenizer:
    """Pieces of text by a pattern, each encoded by the transducer; pieces that come again are looked up."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, half: dict[int, tuple[int, int]] | None = None):
        import regex

        self.split = regex.compile(pattern).findall
        self.transducer = Transducer(ranks, half)
        self.decoder = Decoder(self.transducer.token)
        self.cache: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def encode(self, text: str) -> array:
        pieces = self.split(text)
        found = list(map(self.cache.get, pieces))
        at = -1
        for _ in range(found.count(None)):
            at = found.index(None, at + 1)
            found[at] = self._piece(pieces[at])
        return array("I", chain.from_iterable(found))

    def _piece(self, piece: str) -> tuple[int, ...]:
        """The tokens of a piece that is not in the newest part of the cache, or was not when the text was begun."""
        ids = self.cache.get(piece) or self.older.get(piece)
        if ids is None:
            ids = self.transducer.encode(piece.encode())
        if len(piece) <= 64:
            if len(self.cache) >= CACHED_PIECES:  # what was asked for since the last time lives on
                self.cache, self.older = {}, self.cache
            self.cache[piece] = ids
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        return self.decoder.feed(ids) + self.decoder.finish()


_KEPT: dict[tuple, Tokenizer] = {}


def _tokenizer(key: tuple, ranks: dict[bytes, int], half: dict[int, tuple[int, int]], pattern: str) -> Tokenizer:
    """This worker's tokenizer: the states that one task has made serve the next."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Tokenizer(ranks, pattern, half)
        gc.freeze()  # the vocabulary's tables stay, so collections need not walk through them
    return _KEPT[key]


def encoded(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int> and exact (decoding the ids gives the text); a null text is empty and has no ids."""
    ranks = load_ranks(ranks_path)
    sent = documents.sparkSession.sparkContext.broadcast((ranks, halves(ranks)))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("exact", pa.bool_())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer((ranks_path, pattern), *sent.value, pattern)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids = [tokenizer.encode(t) for t in texts]
                exact = [tokenizer.decode(i) == t for i, t in zip(ids, texts, strict=True)]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.frombuffer(b"".join(i.tobytes() for i in ids), dtype=np.uint32).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(exact)], schema=schema)

    return small_batches(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(scan, "doc_id long, ids array<int>, exact boolean")


def decoded(ids: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and text from doc_id and ids; null ids are none, ids that the vocabulary lacks an error."""
    sent = ids.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder({r: t for t, r in sent.value.items()})
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([decoder.feed(x or ()) + decoder.finish() for x in part.column("ids").to_pylist()], pa.string())], schema=schema)

    return small_batches(ids.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>"))).mapInArrow(scan, "doc_id long, text string")


def digests(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Round trip per row of documents: doc_id, n_tokens, ids_sha256, decoded_sha256; nothing larger leaves the task."""
    ranks = load_ranks(ranks_path)
    sent = documents.sparkSession.sparkContext.broadcast((ranks, halves(ranks)))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer((ranks_path, pattern), *sent.value, pattern)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = tokenizer.encode(text.as_py() or "")
                rows.append((doc, len(ids), hashlib.sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(ids).encode()).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return small_batches(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(scan, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
