"""The batched Viterbi pass finds the best path of every text."""

import random

import numpy as np

from leafwright.llm import language


def plain(s, after, switch, at_stop):
    """Best path score by the full recurrence over all pairs of labels."""
    n, k = s.shape
    best = s[0].copy()
    for i in range(1, n):
        cost = at_stop if after[i] else switch
        best = np.array([max(best[j] - (cost if j != x else 0.0) for j in range(k)) for x in range(k)]) + s[i]
    return best.max()


def score_of(path, s, after, switch, at_stop):
    return sum(s[i, k] for i, k in enumerate(path)) - sum((at_stop if after[i] else switch) for i in range(1, len(path)) if path[i] != path[i - 1])


class Fixed(language.Model):
    def __init__(self, table):
        super().__init__([str(i) for i in range(len(next(iter(table.values()))))], np.zeros((1, 1)), np.zeros((7, 1), dtype=bool))
        self.fixed = table

    def score(self, unit):
        return self.fixed[unit]


def test_every_path_is_the_best_one():
    rng = random.Random(1)
    table = {f"w{i}": np.array([rng.choice([0.0, -0.5, -1.5, -4.0, -9.0]) for _ in range(4)]) for i in range(60)}
    model = Fixed(table)
    texts = []
    for _ in range(3000):
        n = rng.choice([0, 1, 2, 3, 5, 8, 21])
        texts.append(([f"w{rng.randrange(60)}" for _ in range(n)], [False] + [rng.random() < 0.2 for _ in range(n - 1)] if n else []))
    for (units, after), (path, s) in zip(texts, model.label_all(texts, cells=200)):
        assert len(path) == len(units)
        if units:
            assert np.array_equal(s, np.array([table[u] for u in units]))
            assert abs(score_of(path, s, after, language.SWITCH, language.SWITCH_AT_STOP) - plain(s, after, language.SWITCH, language.SWITCH_AT_STOP)) < 1e-9


def test_two_languages_are_not_given_a_third():
    table = {"a": np.array([0, -4, -1.4]), "b": np.array([-4, 0, -1.4])}
    path, _ = Fixed(table).label(["a", "a", "b", "b"], [False, False, True, False])
    assert path.tolist() == [0, 0, 1, 1]


def test_remembered_scores_survive_a_full_table(monkeypatch):
    monkeypatch.setattr(language, "_KEPT", 5)
    table = {f"w{i}": np.array([float(-i), 0.0]) for i in range(40)}
    model = Fixed(table)
    for i in range(0, 40, 4):
        units = [f"w{k}" for k in range(i, i + 4)]
        assert np.array_equal(model.scores(units), np.array([table[u] for u in units]))


def test_texts_without_units_among_others():
    rows = np.zeros((language.BUCKETS, 2))
    model = language.Model(["a", "b"], rows, np.ones((7, 2), dtype=bool))
    got = list(language.segments_all(model, ["One two. Three four five.", "", "12 ?", "x" * 50], chars=20))
    assert [len(s) for s, _ in got] == [1, 0, 0, 1] and len(got[0][1]) == 2
    assert list(language.segments_all(model, [])) == []
