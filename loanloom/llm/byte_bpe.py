"""Byte-level BPE as a finite-state transducer, and its streaming inverse.

Encoding.  Merging by rank has two properties.  The encoding of a prefix of a word never depends on what follows except
in its last tokens; and a token sequence is an encoding exactly if each neighbouring pair is the encoding of its own
bytes.  So the encoding of a prefix is that of a shorter prefix plus one token, the only one that fits its predecessor.
A state of the transducer therefore holds the bytes that can still begin a longer token, and for each place within them
the tokens since the last certain one.  Reading a byte adds one place, drops places no token can start from, and emits
what all remaining places agree on: the lookahead is bounded by the longest token.  States are determinised when first
met and kept in a bounded table.

Decoding.  Token bytes pass through a state machine for UTF-8; a character split between tokens, or between chunks of a
stream, waits in the machine until its last byte arrives.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.llm.common import chunks

#: Transitions, fitting pairs and words kept by a worker; a table is emptied when full, of words the older half.
TRANSITIONS, PAIRS, WORDS = 400_000, 200_000, 120_000
#: Longer words are not remembered.
LONGEST = 64
#: Tokens that the decoder passes at once if each is of whole characters.
RUN = 128
#: Characters of text encoded before their ids are handed on.
CHUNK = 1 << 20

_NEVER = 1 << 60  # the rank of what can't be joined
_ANY_TOKEN = -2  # stands for the last emitted token in a state where it no longer matters


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Transducer:
    """Words (bytes) to token ids, by the ranks of a byte-level BPE vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every byte must be a token")
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.starts = {token[:k] for token in ranks for k in range(1, len(token))}
        self._fits: dict[tuple[int, int], bool] = {}
        self._lives: dict[int, list[tuple[int, bytes, bytes]] | None] = {}
        self._reset()

    def _reset(self) -> None:
        self._states: list[tuple] = [(b"", ((),), -1)]
        self._numbers: dict[tuple, int] = {self._states[0]: 0}
        self._next: dict[int, tuple[int, tuple[int, ...]]] = {}

    def merge(self, word: bytes) -> list[int]:
        """The definition: join the neighbours of lowest rank, leftmost first, until none can be joined."""
        return [self.ranks[p] for p in self._history(word)[0]]

    def _history(self, word: bytes) -> tuple[list[bytes], list[tuple[int, bytes, bytes]]]:
        """The merged parts; and of each join its rank with the first and last part after it."""
        parts, joins = [word[i : i + 1] for i in range(len(word))], []
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
            if rank == _NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            joins.append((rank, parts[0], parts[-1]))
        return parts, joins

    def _grown(self, token: int) -> list[tuple[int, bytes, bytes]] | None:
        """How a token comes about: first and last part from the start on, each with the rank of the join that ends it.
        None for a token that merging its bytes doesn't give."""
        if token not in self._lives:
            word = self.bytes_of[token]
            parts, joins = self._history(word)
            ends = [(word[:1], word[-1:]), *(j[1:] for j in joins)]
            self._lives[token] = [(rank, *end) for rank, end in zip([*(j[0] for j in joins), _NEVER], ends, strict=True)] if len(parts) == 1 else None
        return self._lives[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left`` (-1: nothing): whether merging both tokens' bytes together gives them.

        Both come about side by side, the lower rank first; they don't fit if what meets at their border would join first.
        """
        found = self._fits.get((left, right))
        if found is None:
            b = self._grown(right)
            found = b is not None
            if found and left >= 0:
                a, i, j = self._grown(left), 0, 0
                while found and (i < len(a) and j < len(b)):
                    across = self.ranks.get(a[i][2] + b[j][1], _NEVER)
                    if across != _NEVER and across < a[i][0] and across <= b[j][0]:
                        found = False
                    elif a[i][0] <= b[j][0]:
                        i += 1
                    else:
                        j += 1
            if len(self._fits) >= PAIRS:
                self._fits.clear()
            self._fits[left, right] = found
        return found

    def _read(self, state: tuple, byte: int) -> tuple[tuple, tuple[int, ...]]:
        window, tails, before = state
        seen = window + bytes([byte])
        rank_of, starts, fitting = self.ranks.get, self.starts, self._fits.get
        live: list[tuple[int, ...] | None] = []
        last, first = None, len(tails)
        for k, tail in enumerate(tails):
            if tail is None:
                if live:
                    live.append(None)
                continue
            part = seen[k:] if k else seen
            if last is None and (token := rank_of(part)) is not None:
                left = tail[-1] if tail else before
                fit = fitting((left, token))
                if self.fits(left, token) if fit is None else fit:
                    last = (*tail, token)
            if part in starts:
                if not live:
                    first = k
                live.append(tail)
            elif live:
                live.append(None)
        if last is None:
            raise AssertionError("some token always fits")
        live.append(last)
        sure = 0
        if len(live) == 1:
            sure = len(last)
        elif () not in live:
            known = [tail for tail in live if tail is not None]
            while sure < min(map(len, known)) and len({tail[sure] for tail in known}) == 1:
                sure += 1
        emitted = last[:sure]
        left = tuple([tail if tail is None else tail[sure:] for tail in live]) if sure else tuple(live)
        before = emitted[-1] if emitted else before
        return (seen[first:], left, before if () in left else _ANY_TOKEN), emitted

    def encode(self, word: bytes) -> tuple[int, ...]:
        """Token ids of one word; a word that is itself a token is that token, as the library has it."""
        whole = self.ranks.get(word)
        if whole is not None:
            return (whole,)
        out: list[int] = []
        at, step = 0, self._next.get
        for byte in word:
            hit = step(at << 8 | byte)
            if hit is None:
                if len(self._next) >= TRANSITIONS:
                    here = self._states[at]
                    self._reset()
                    at, step = self._number(here), self._next.get
                state, emitted = self._read(self._states[at], byte)
                hit = self._next[at << 8 | byte] = self._number(state), emitted
            at, emitted = hit
            if emitted:
                out += emitted
        return (*out, *self._states[at][1][-1])

    def _number(self, state: tuple) -> int:
        found = self._numbers.get(state)
        if found is None:
            found = self._numbers[state] = len(self._states)
            self._states.append(state)
        return found


class Words(dict):
    """word -> token ids: what this worker has met lately; others pass the transducer."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer, self.older = transducer, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.older.get(word)
        if ids is None:
            ids = self.transducer.encode(word.encode())
        if len(word) <= LONGEST:
            if len(self) >= WORDS:  # words that come often move on from the older half
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


# States of the UTF-8 machine: the count of bytes to come, with the narrower range of the next byte where there is one.
_ANY = (0x80, 0xBF)


def _utf8_step(state: tuple[int, int, int], byte: int) -> tuple[int, int, int]:
    left, low, high = state
    if left:
        if not low <= byte <= high:
            raise ValueError(f"byte {byte:#x} can't continue a character")
        return (left - 1, *_ANY) if left > 1 else (0, 0, 0)
    if byte < 0x80:
        return 0, 0, 0
    if 0xC2 <= byte <= 0xDF:
        return 1, *_ANY
    if 0xE0 <= byte <= 0xEF:
        return 2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF
    if 0xF0 <= byte <= 0xF4:
        return 3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF
    raise ValueError(f"byte {byte:#x} can't begin a character")


class Decoder:
    """Token ids to text, chunk by chunk.

    The machine moves a token at a time: what a token's bytes do to a state is worked out once and looked up after that.
    Tokens of whole characters leave it where it starts, so a run of them is passed in one step.
    """

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self._moves: dict[tuple[tuple[int, int, int], int], tuple[tuple[int, int, int], int]] = {}
        self.partial = frozenset(token for token, part in bytes_of.items() if not (part.isascii() or self._whole(token)))
        self.start()

    def start(self) -> None:
        self.state, self.waiting = (0, 0, 0), b""

    def _whole(self, token: int) -> bool:
        """Whether the machine, from its start, is there again after the token."""
        try:
            return not self._move((0, 0, 0), token)[0][0]
        except ValueError:
            return False

    def _move(self, state: tuple[int, int, int], token: int) -> tuple[tuple[int, int, int], int]:
        """The state after a token, and how many of its last bytes belong to a character not yet complete (-1: all)."""
        complete = -1
        for i, byte in enumerate(token_bytes := self.bytes_of[token]):
            state = _utf8_step(state, byte)
            if not state[0]:
                complete = i
        return state, -1 if complete < 0 else len(token_bytes) - 1 - complete

    def feed(self, ids: list[int]) -> str:
        """The characters that these tokens complete."""
        state, parts, held = self.state, [self.waiting], len(self.waiting)
        for at in range(0, len(ids), RUN):
            run = ids[at : at + RUN]
            if not state[0] and self.partial.isdisjoint(run):
                parts += map(self.bytes_of.__getitem__, run)
                continue
            for token in run:
                move = self._moves.get((state, token))
                if move is None:
                    move = self._moves[state, token] = self._move(state, token)
                state, tail = move
                part = self.bytes_of[token]
                parts.append(part)
                held = held + len(part) if tail < 0 else tail
        whole = b"".join(parts)
        self.state, self.waiting = state, whole[len(whole) - held :]
        return whole[: len(whole) - held].decode()

    def end(self) -> None:
        if self.state[0]:
            raise ValueError("the tokens end within a character")
        self.start()


@lru_cache(maxsize=2)
def _codec(path: str, pattern: str) -> tuple:
    import regex

    transducer = Transducer(read_ranks(path))
    return regex.compile(pattern), Words(transducer), Decoder(transducer.bytes_of)


@lru_cache(maxsize=2)
def _spelled(path: str) -> dict[int, str]:
    return {i: str(i) for i in _codec_tokens(path)}


def _codec_tokens(path: str) -> Iterable[int]:
    return read_ranks(path).values()


def encode_texts(texts: Iterable[str], ranks_path: str, pattern: str) -> Iterator[list[int]]:
    """Token ids of each text, every match of ``pattern`` encoded by itself."""
    split, words, _ = _codec(ranks_path, pattern)
    for text in texts:
        yield list(chain.from_iterable(map(words.__getitem__, split.findall(text))))


def decode_ids(ids: list[int], ranks_path: str, pattern: str, chunk: int = 4096) -> Iterator[str]:
    """The text of token ids, in pieces: each chunk of ids gives the characters it completes."""
    decoder = _codec(ranks_path, pattern)[2]
    decoder.start()
    for i in range(0, len(ids), chunk):
        yield decoder.feed(ids[i : i + chunk])
    decoder.end()


def encoded(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the key, ``ids`` (array of int), ``n_tokens`` and ``intact``, whether the ids decode to
    the text.

    Null and empty texts give no ids; repeated rows and null keys give a row each; other columns are left out.  A task
    gives its tables back at its end, so that workers waiting for other work hold none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                texts, at = [t or "" for t in batch.column(1).to_pylist()], 0
                for part in chunks(texts, map(len, texts), CHUNK):
                    ids = list(encode_texts(part, ranks_path, pattern))
                    intact = ["".join(decode_ids(x, ranks_path, pattern)) == t for x, t in zip(ids, part, strict=True)]
                    keys = batch.column(0).slice(at, len(part))
                    at += len(part)
                    yield pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.list_(pa.int32())), pa.array(map(len, ids), pa.int64()), pa.array(intact)], [key, "ids", "n_tokens", "intact"])
        finally:
            _codec.cache_clear()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>, n_tokens long, intact boolean")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the key, ``n_tokens``, ``ids_sha256`` (decimal ids joined by commas) and
    ``decoded_sha256`` (the decoded bytes), both lowercase hex.  Ids and texts stay in the task that made them.

    Null and empty texts have no tokens and the digests of nothing; repeated rows and null keys give a row each; other
    columns are left out; an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = _spelled(ranks_path)
        for batch in batches:
            n, encoded, decoded = [], [], []
            for ids in encode_texts((t or "" for t in batch.column(1).to_pylist()), ranks_path, pattern):
                n.append(len(ids))
                encoded.append(sha256(",".join(map(spelled.__getitem__, ids)).encode()).hexdigest())
                digest = sha256()
                for piece in decode_ids(ids, ranks_path, pattern):
                    digest.update(piece.encode())
                decoded.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
