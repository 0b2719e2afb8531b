"""The writer of id files looks ahead instead of stepping the model; the encoder's memory of words changes no id."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from sparkloom.llm import idfile, tokens


def some_ids(n: int) -> np.ndarray:
    r = np.random.default_rng(7)
    return np.where(r.random(n) < 0.5, r.zipf(1.2, n) % 50000, np.tile(r.integers(0, 50000, 300), n // 300 + 1)[:n]).astype(np.uint32)


def test_the_writer_never_steps_the_model_and_its_bytes_are_those_of_one_that_does(monkeypatch):
    ids = some_ids(3 * idfile.BLOCK + 100)
    _, places = idfile._Header.of(ids)
    grid, _ = idfile._blocks(places)
    model, ahead = idfile._Model(len(grid)), idfile._foreseen(grid)
    assert len(ahead) == idfile.BLOCK
    for t, seen in enumerate(ahead):
        model.look()
        now = np.ascontiguousarray(grid[:, t])
        assert np.array_equal(seen & 7, model.conf) and np.array_equal(seen & 8 > 0, model.guess == now)
        assert np.array_equal(seen > 15, np.broadcast_to(model.guess[0] != model.guess[1], seen.shape))
        model.learn(now)

    def refuse(*_):
        raise AssertionError("the writer steps the model")

    monkeypatch.setattr(idfile, "_Model", refuse)
    assert hashlib.md5(idfile.encode_ids(ids)).hexdigest() == "05c19453103513e79072e5ec65fa6450"


ALPHABET = ["a", "b", "é", "ß", "×", "÷", "Ä", " ", "\n", ".", ",", "!", "1", " ", "　", "中", "\x85", "\x1c", "א", "<|endoftext|>", " the", " word", "\t", "(", "\r"]


@pytest.mark.parametrize("words", [800_000, 12])
def test_pieces_equal_the_library_whatever_is_remembered(words, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", words)
    e, r = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json")), random.Random(words)
    for _ in range(400):
        texts = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 12))) if r.random() > 0.05 else None for _ in range(r.randint(0, 6))]
        ids, to = e.encode(texts)
        for k, t in enumerate(texts):
            assert ids[to[k] : to[k + 1]].tolist() == e.lib.encode(t or "", add_special_tokens=False).ids, t
        assert len(e.words) == len(e.sums) < words + 100


def test_words_with_one_sum_are_told_apart(monkeypatch):
    monkeypatch.setattr(tokens, "_sums", lambda words: np.zeros(len(words), np.uint64))
    e = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for t in ("one two three", "three two one", "two two four one"):
        assert e.encode([t])[0].tolist() == e.lib.encode(t, add_special_tokens=False).ids


def test_no_small_rest_of_blocks_is_coded_alone():
    for n in (1, 295, 2048, 2343, 3071, 3072, 5000):
        groups = [range(n)[g] for g in idfile._groups(n)]
        assert [k for g in groups for k in g] == list(range(n)) and max(map(len, groups)) <= idfile.LANES * 3 // 2
        assert len(groups) == 1 or min(map(len, groups)) >= idfile.LANES * 3 // 4


@pytest.mark.parametrize("different", [300, 8190, 8191, 9000])
def test_slots_are_as_wide_as_the_ids_need(different, monkeypatch):
    kinds = []

    class Model(idfile._Model):
        def __init__(self, n, kind):
            kinds.append(kind)
            super().__init__(n, kind)

    monkeypatch.setattr(idfile, "_Model", Model)
    r = np.random.default_rng(different)
    ids = np.concatenate([np.arange(different), np.repeat(r.integers(0, different, 900), 4), r.permutation(different), [different - 1] * 9]).astype(np.uint32)
    assert np.array_equal(idfile.decode_ids(idfile.encode_ids(ids)), ids)
    assert kinds == [np.uint16 if different < 8191 else np.int32]


def test_the_encoder_looks_for_specials_once_a_slice(monkeypatch):
    e = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))

    def refuse(*_):
        raise AssertionError("every text is searched")

    monkeypatch.setattr(tokens.pc, "match_substring", refuse)
    monkeypatch.setattr(e, "_learn", lambda new, learn=e._learn: (monkeypatch.undo(), learn(new))[1])
    for texts in ([], [None], [""], ["one two", "", None, "three. four"]):
        ids, to = e.encode(texts)
        for k, t in enumerate(texts):
            assert ids[to[k] : to[k + 1]].tolist() == e.lib.encode(t or "", add_special_tokens=False).ids
