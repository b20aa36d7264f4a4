"""Ids of the packing encoder against the library, and cuts against plain programmes."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ephemera.llm import packing
from ephemera.llm.packing import GAP, SENTENCE, TRUNCATION, Encoder, best_cuts, cut_stream

PLAIN = [chr(c) for c in [*range(0x1C), *range(0x20, 0x85), *range(0x86, 0x100)]] + list("‐–—‘’“”•…€")
ODD = list("\x1c\x1f\x85 　日本語ΣÅǅ١²½Ⅷ́\U0001f600İ")


def random_texts(n, seed):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        chars = r.choice([PLAIN, "ab c' .,\n", PLAIN + ODD, "a1 \n\t's", "it's we'll I'd X'S 'VE "])
        out.append("".join(r.choice(chars) for _ in range(r.randrange(60))))
    return out


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_library(name):
    path = str(public_tokenizers.path(name))
    texts = random_texts(4000, 1) + ["", "a" * 5000, "  ", "x<|endoftext|> y  <|endoftext|>", "double  spaced  text  here", " <|startoftext|>"] + random_texts(200, 2)
    encoder, library = Encoder(path), Tokenizer.from_file(path)
    assert encoder.by_unit == name.startswith("byte")
    ids, counts = encoder.encode([t.encode() for t in texts])
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]


def test_memory_of_the_encoder_is_bounded(monkeypatch):
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    monkeypatch.setattr(Encoder, "limit", 300)
    monkeypatch.setattr(Encoder, "limit_size", 4000)
    encoder, library = Encoder(path), Tokenizer.from_file(path)
    r = random.Random(3)
    for k in range(40):
        texts = [" ".join(r.choice("abcde") * r.randrange(1, 9) + str(r.randrange(50)) for _ in range(60)) for _ in range(5)] + ["<|endoftext|> whole " * 99, "long" * 200]
        ids, counts = encoder.encode([t.encode() for t in texts])
        assert ids.tolist() == [i for t in texts for i in library.encode(t, add_special_tokens=False).ids] and counts.sum() == len(ids)
        assert len(encoder.units) <= 300 and not any(len(u) > packing.LONGEST for u in encoder.units)
        assert encoder.units.size + len(encoder.flat) <= 4000 and len(encoder.start) == encoder.units.total + 1


def test_frequent_pre_tokens_stay_when_memory_is_full(monkeypatch):
    """The model is asked once for each pre-token that comes again and again, however many rare ones come between."""
    monkeypatch.setattr(Encoder, "limit", 400)
    encoder, asked = Encoder(str(public_tokenizers.path("byte_bpe_50k.json"))), []

    class Counted:
        tokenize = staticmethod(lambda unit, model=encoder.model: asked.append(unit) or model.tokenize(unit))

    encoder.model = Counted
    for k in range(30):
        encoder.encode([" ".join(f"{c}{d}often" for c in "abcde" for d in "fghijklmnopqrst").encode(), "".join(f" rare{'xyz'[j % 3] * (j + 1)}q{'uvw'[k % 3] * (k + 1)}" for j in range(100)).encode()])
    assert len(asked) == len(set(asked)) == 75 + 30 * 100


def plain_costs(places, penalties, size, truncation):
    cost = [0.0]
    for j in range(1, len(places)):
        options = [cost[i] + size - (places[j] - places[i]) for i in range(j) if places[j] - places[i] <= size]
        options += [cost[i] + 2 * size - (places[j] - places[i]) + truncation for i in range(j) if size < places[j] - places[i] <= 2 * size]
        cost.append(min(options) + penalties[j])
    return cost


@pytest.mark.parametrize("seed", range(8))
def test_best_cuts_equals_plain_programme(seed):
    r = random.Random(seed)
    places = [0]
    while len(places) < 150:
        places.append(places[-1] + r.randrange(1, 12))
    penalties = [float(r.choice([0, 1, 4])) for _ in places]
    cost, before = best_cuts(np.array(places), np.array(penalties), 20, 3.0)
    assert cost.tolist() == pytest.approx(plain_costs(places, penalties, 20, 3.0))
    for j in range(1, len(places)):
        length = places[j] - places[before[j]]
        own = 20 - length if length <= 20 else 40 - length + 3.0
        assert cost[j] == pytest.approx(cost[before[j]] + own + penalties[j])


@pytest.mark.parametrize("last", [False, True])
@pytest.mark.parametrize("seed", range(6))
def test_cut_stream_is_optimal(seed, last):
    """The cost of the cuts equals that of a plain programme over documents, sentences and places at distance GAP."""
    r, size = random.Random(seed), 64
    total = r.randrange(700, 1500)
    ends = np.array(sorted({*(r.randrange(1, total) for _ in range(9)), total}))
    sentences = np.array(sorted({r.randrange(1, total) for _ in range(r.choice([0, 5, 60]))}), np.int64)
    places = sorted({0, *ends.tolist(), *sentences.tolist(), total})
    penalty = {p: 0.0 if p in ends or p in (0, total) else SENTENCE for p in places}
    for a, b in zip(places, places[1:]):
        for k in range(1, (b - a) // GAP + 1) if b - a > GAP else ():
            penalty.setdefault(a + k * GAP, TRUNCATION)
    places = sorted(penalty)
    cost = plain_costs(places, [penalty[p] for p in places], size, TRUNCATION)
    cuts = cut_stream(ends, sentences, total, size, last)
    assert cuts == sorted(cuts) and max(np.diff([0, *cuts])) <= size
    if last:
        assert cuts[-1] == total
    else:
        end = min((c, p) for c, p in zip(cost, places) if p > total - size)
        assert cost[places.index(cuts[-1])] == pytest.approx(end[0])
    # what the cuts cost, by their own account; the last sequence may be split into powers of two
    account = sum(size - int(n) for n in np.diff([0, *cuts])) + sum(penalty.get(c, TRUNCATION) for c in cuts)
    best = cost[places.index(cuts[-1])]
    assert account == pytest.approx(best) if not last else account <= best + size * 7
