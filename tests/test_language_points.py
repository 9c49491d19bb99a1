"""Texts as code points, scored without a step of Python for each letter."""

import random

import numpy as np

from lectern.operators import language


def test_points_are_the_letters_of_any_text():
    r = random.Random(1)
    odd = ["".join(r.choice("aé  ß1_Ж ת中اऀं\t\n-İ\U0001f600") for _ in range(r.randint(0, 40))) for _ in range(500)]
    for text in [*odd, *language.SAMPLES.values(), "", " ", " a", "a ", "1", "ΑΣ"]:
        assert "".join(map(chr, language.points_of(text))) == language.letters(text)


def test_known_trigrams_are_looked_up_together(monkeypatch):
    """A text whose trigrams are known costs no call for any of them, also after the memory of trigrams was cleared, and scores the same."""
    p, points = language.Profiles(), language.points_of(language.SAMPLES["vi"])
    want = sum(p.logs("".join(map(chr, points[i : i + 3]))) for i in range(len(points) - 2))
    assert np.allclose(p.scores(points), want)
    monkeypatch.setattr(language, "REMEMBERED", 10)
    assert np.allclose(p.scores(language.points_of("so it was")), language.Profiles().scores(language.points_of("so it was")))
    assert np.allclose(p.scores(points), want)
    monkeypatch.setattr(p, "logs", None)
    assert np.allclose(p.scores(points), want)
