"""What the language model computes once instead of again and again."""

import collections

import numpy as np
import pyarrow as pa

from webloom.llm import lm


def spelling(words):
    return lm.Spelling(lm.Spelling.sums_of(words, np.arange(1, len(words) + 1)))


def test_steps_are_looked_up_once(monkeypatch):
    model, looked_up = spelling([b"abc", b"abd", b"bcd", b"xyz"]), []
    search = np.searchsorted
    words = [b"abc", b"zzzzzzzzzz", b"abq", b"q", "é".encode(), b"a"]
    want = model.log10(words)
    monkeypatch.setattr(lm.np, "searchsorted", lambda a, v, *x: looked_up.append(np.size(v)) or search(a, v, *x))
    got = model.log10(words * 1000)
    monkeypatch.undo()
    assert max(looked_up) < 40  # steps of these words, not of their copies
    assert np.allclose(got, np.tile(want, 1000), rtol=1e-12)


def test_step_probabilities_back_off():
    """Against the definition, a byte at a time."""
    words = [b"abc", b"abd", b"bcd", b"xyz"]
    model, sums = spelling(words), lm.Spelling.sums_of(words, np.arange(1, 5))
    tables = [dict(zip(k.tolist(), n.tolist())) for k, n in sums]
    for word in (b"abc", b"abq", b"q", b"zabd", b"a" * 9):
        total, padded = 0.0, [lm.ENDS] * 3 + list(word)
        for i, symbol in enumerate([*word, lm.ENDS]):
            p, context = (tables[0].get(symbol, 0) + 0.5) / (sum(tables[0].values()) + 257 * 0.5), 0
            for back in (1, 2, 3):
                context = context * 257 + padded[i + 3 - back]
                own = {k: n for k, n in tables[back].items() if k // 257 == context}
                if own:
                    p = (own.get(context * 257 + symbol, 0) + len(own) * p) / (sum(own.values()) + len(own))
            total += np.log10(p)
        assert np.isclose(model.log10([word])[0], total)


def test_rare_words_of_each_text():
    texts = [[b"x", b"y", b"x"], [], [b"z", b"y"], [], [b"z", b"z"]]
    owner = np.repeat(np.arange(5), [len(x) for x in texts])
    rare, which, pairs, times, starts = lm.rare_words(pa.array([w for x in texts for w in x], pa.large_binary()), owner, 5)
    kinds = rare.to_pylist()
    assert len(kinds) == len(set(kinds)) == 3 and [kinds[i] for i in which] == [w for x in texts for w in x]
    for text, a, b in zip(texts, starts, starts[1:]):
        assert {kinds[k]: n for k, n in zip(pairs[a:b], times[a:b])} == collections.Counter(text)
    none = lm.rare_words(pa.array([], pa.large_binary()), np.empty(0, np.int64), 2)
    assert none[4].tolist() == [0, 0, 0]
