import base64
from hashlib import sha256

import public_tokenizers as public
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from cases import documents, texts
from loanloom.llm import byte_bpe, token_counts

MODEL, RANKS = public.path("piece_bpe_32k.model"), public.path("byte_bpe_multi_50k.tiktoken")
ODD = ["<s> hi </s>", "<unk>", "▁▁a▁b", "a" * 3000, "ab \n\n  c\t d ", "é" * 50, "😀😀 x", " ", "\n", "it's we'll 123 !!?", "\x00a"]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_token_counts_equal_the_library(spark):
    rows = texts() + [(900 + i, t, "x") for i, t in enumerate(ODD)]
    pieces = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    found = token_counts.count_tokens(documents(spark, rows), MODEL, limit=200).collect()
    expected = sorted((str(i), len((t or "").encode()), len(pieces.encode(t or "")), len(pieces.encode(t or "")) > 200) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in found) == expected


def test_counts_do_not_depend_on_the_table_or_the_cache(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE", 3)
    words = [t for _, t, _ in texts() if t] + ODD
    plain, warm = token_counts.Lengths({}, MODEL), token_counts.Lengths({" the": 1}, MODEL)
    assert [plain.count([t])[0] for t in words] == warm.count(words)


def test_round_trip_equals_the_library(spark, library):
    rows = texts() + [(900 + i, t, "x") for i, t in enumerate(ODD)]
    found = byte_bpe.round_trip(documents(spark, rows), RANKS, public.PATTERN).collect()

    def row(i, t):
        ids = library.encode_ordinary(t or "")
        return str(i), len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256((t or "").encode()).hexdigest()

    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == sorted(row(i, t) for i, t, _ in rows)
    ids = byte_bpe.encoded(documents(spark, rows), RANKS, public.PATTERN).collect()
    assert all(r.intact and len(r.ids) == r.n_tokens for r in ids) and len(ids) == len(rows)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    ids = next(byte_bpe.encode_texts([text], RANKS, public.PATTERN))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))} if not hasattr(test_any_text, "lib") else None
    if ranks:
        test_any_text.lib = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert ids == test_any_text.lib.encode_ordinary(text)
    for chunk in (1, 2, 7):  # characters split between chunks wait in the decoder
        assert "".join(byte_bpe.decode_ids(ids, RANKS, public.PATTERN, chunk)) == text


def test_transducer_equals_merging_and_survives_emptied_tables(monkeypatch):
    import random

    monkeypatch.setattr(byte_bpe, "TRANSITIONS", 50)
    monkeypatch.setattr(byte_bpe, "PAIRS", 20)
    machine, rnd = byte_bpe.Transducer(byte_bpe.read_ranks(RANKS)), random.Random(5)
    for _ in range(400):
        word = bytes(rnd.choice(b"therinago \xc3\xa9") for _ in range(rnd.randint(1, 30)))
        if word not in machine.ranks:
            assert list(machine.encode(word)) == machine.merge(word)


def test_decoder_refuses_broken_text():
    decoder = byte_bpe.Decoder({0: b"\xc3", 1: b"a", 2: b"\xff"})
    decoder.feed([0])
    with pytest.raises(ValueError):
        decoder.end()
    decoder.start()
    for ids in ([0, 1], [2]):
        decoder.start()
        with pytest.raises(ValueError):
            decoder.feed(ids)


def test_the_machine_steps_only_where_characters_are_split(monkeypatch):
    """Runs of whole characters are passed at once; split ones, also at the edges of runs, go through the machine."""
    steps, move = [], byte_bpe.Decoder._move
    tokens = {0: b"a", 1: "é".encode(), 2: b"\xc3", 3: b"\xa9", 4: b"\xa9b\xc3", 5: b""}
    decoder = byte_bpe.Decoder(tokens)
    assert decoder.partial == {2, 3, 4}
    monkeypatch.setattr(byte_bpe.Decoder, "_move", lambda self, state, token: steps.append(token) or move(self, state, token))
    assert decoder.feed([0, 1] * 500) == "aé" * 500 and not steps
    for before in (0, 126, 127, 128, 129):
        ids = [0] * before + [2, 4, 3] + [1] * 200 + [2]
        assert decoder.feed(ids) == "a" * before + "ébé" + "é" * 200
        assert decoder.waiting == b"\xc3" and decoder.feed([3, 0]) == "éa"
        decoder.end()


def test_empty_table(spark):
    none = documents(spark).filter("false")
    assert token_counts.count_tokens(none, MODEL).count() == byte_bpe.round_trip(none, RANKS, public.PATTERN).count() == 0


def test_a_pair_is_worked_out_once(monkeypatch):
    asked, fits = [], byte_bpe.Transducer.fits
    monkeypatch.setattr(byte_bpe.Transducer, "fits", lambda self, left, right: asked.append((left, right)) or fits(self, left, right))
    machine = byte_bpe.Transducer(byte_bpe.read_ranks(RANKS))
    words = [a + b for a in ("quor", "vint", "drelm", "é€") for b in ("asku", "ombrel", "ißt", "quork")]
    for word in words:
        assert list(machine.encode(word.encode())) in ([machine.ranks.get(word.encode())], machine.merge(word.encode()))
    assert len(asked) == len(set(asked)) > 50


def test_tasks_of_the_pipeline_give_their_tables_back(spark):
    docs = documents(spark, texts()).repartition(4)
    assert byte_bpe.encoded(docs, RANKS, public.PATTERN).filter("not intact").count() == 0

    def kept(batches):
        from loanloom.llm import byte_bpe as module

        for batch in batches:
            yield batch.assign(id=module._codec.cache_info().currsize)

    assert {r.id for r in spark.range(0, 400, 1, 8).mapInPandas(kept, "id long").collect()} == {0}
