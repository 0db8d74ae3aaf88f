"""Token counts of whole texts for a sentencepiece BPE model, by a two-tier lookup on the map side.

A word-piece model never joins what stands before a space with what follows it, so a text's token count is the sum over
its pre-tokens (spaces and the word after them).  The lengths of the corpus's most frequent pre-tokens are broadcast as a
compact table of proven size (tier 1); every other pre-token is encoded where it occurs and remembered in a bounded cache
of the Python worker (tier 2).  No occurrence of a pre-token is shuffled: the only exchange carries each task's bounded
summary of what is frequent, and the table decides speed alone, never a count.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of the broadcast table, and of what each task reports of its own pre-tokens.
TABLE, REPORT = 16_384, 4_096
#: Pre-tokens above this many characters are neither in the table nor cached: they rarely come twice.
LONGEST = 48
#: Pre-tokens in each half of a worker's cache; when the newer half is full, the older one goes.
CACHE = 200_000
#: Characters of text that are looked up together.
STRIDE = 1 << 20

_SPACE = "▁"  # the piece alphabet's sign for a space
_PRE_TOKEN = re.compile(r"[ \n]+[^ \n]*")


def pre_tokens(text: str) -> list[str]:
    """The parts of a text between which the model joins nothing; the model puts a space before every text."""
    return _PRE_TOKEN.findall(" " + text.replace(_SPACE, " ")) if text else []


@lru_cache(maxsize=2)
def measure(model: str) -> Callable[[list[str]], list[int]]:
    """Token counts of pre-tokens.  Refuses a model for which counts of pre-tokens don't add up."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=model)
    for i in range(pieces.get_piece_size()):
        piece = pieces.id_to_piece(i)
        if _SPACE in piece.lstrip(_SPACE) or "\n" in piece:
            raise ValueError(f"piece {piece!r} crosses a pre-token boundary")
    if "".join(pieces.encode("a  b ", out_type=str)) != f"{_SPACE}a{_SPACE * 2}b{_SPACE}":
        raise ValueError("the model rewrites spaces; its pre-tokens can't be counted apart")
    before = len(pieces.encode("\n"))
    # the line break keeps the space that the model adds apart from the pre-token
    return lambda words: [len(ids) - before for ids in pieces.encode(["\n" + w for w in words], num_threads=1)]


class Lengths(dict):
    """pre-token -> token count.  The items are tier 1; what misses goes to the worker's cache, then to the model."""

    def __init__(self, table: dict[str, int], model: str):
        super().__init__(table)
        self.cache: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.model = model

    def __missing__(self, word: str) -> int:
        return self.cache[word]

    def count(self, texts: list[str | None]) -> list[int]:
        """Token counts of some texts; what all of them miss is encoded in one call."""
        if len(self.cache) > CACHE:
            self.older, self.cache = self.cache, {}
        split = [pre_tokens(t or "") for t in texts]
        new = [w for w in set(chain.from_iterable(split)) if w not in self and w not in self.cache]
        self.cache.update((w, self.older[w]) for w in new if w in self.older)
        misses = [w for w in new if w not in self.cache]
        if misses:
            self.cache.update(zip(misses, measure(self.model)(misses), strict=True))
        counts = [sum(map(self.__getitem__, words)) for words in split]
        for word in misses:
            if len(word) > LONGEST:
                del self.cache[word]
        return counts


def strides(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in order, in lists of about ``STRIDE`` characters."""
    part, held = [], 0
    for text in texts:
        part.append(text)
        held += len(text or "")
        if held >= STRIDE:
            yield part
            part, held = [], 0
    yield part


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[str] = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            seen.update(pre_tokens(text or ""))
            if len(seen) > 16 * REPORT:  # rare ones go; a frequent one comes again
                seen = Counter(dict(seen.most_common(4 * REPORT)))
    rows = [(w, n) for w, n in seen.most_common(REPORT) if len(w) <= LONGEST and n > 1]
    yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["word", "n"])


def frequent_pre_tokens(docs: DataFrame, text: str = "text", size: int = TABLE) -> list[str]:
    """The most frequent pre-tokens of all texts, by the sum of what each task reports; at most ``size``."""
    found = docs.select(F.col(text)).mapInArrow(_report, "word string, n long")
    top = found.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size)
    return [r.word for r in top.collect()]


_READY: dict[str, tuple[object, Lengths]] = {}


def _lengths(model: str, packed: tuple[bytes, bytes]) -> Lengths:
    """This worker's lookup; rebuilt only when another table arrives, so the cache outlives the task."""
    key = hash(packed)
    if model not in _READY or _READY[model][0] != key:
        words = packed[0].decode().split("\0") if packed[0] else []
        _READY[model] = key, Lengths(dict(zip(words, packed[1], strict=True)), model)
    return _READY[model][1]


def count_tokens(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """One row per row of ``docs``: the key, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit``).

    Null and empty texts have 0 bytes and 0 tokens; repeated rows and null keys give a row each; other columns are left
    out; an empty table gives an empty table.  ``model`` is a path that every worker can open.
    """
    words = [w for w in frequent_pre_tokens(docs, text) if "\0" not in w]
    lengths = measure(model)(words)
    words = [w for w, n in zip(words, lengths, strict=True) if n < 256]
    packed = docs.sparkSession.sparkContext.broadcast(("\0".join(words).encode(), bytes(n for n in lengths if n < 256)))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _lengths(model, packed.value)
        for batch in batches:
            texts = batch.column(1)
            n = pa.array(chain.from_iterable(map(lengths.count, strides(texts.to_pylist()))), pa.int64())
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, n, pc.greater(n, limit)], [key, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(counted, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
