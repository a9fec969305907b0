"""The additive model against a plain version of its boosting, and its features against their definitions."""

import math
import random
import re

import numpy as np
import pytest

from weftgraph.llm import quality_classifier as q


def leaf(rows):
    return sum(g for _, g, _ in rows) / (sum(h for _, _, h in rows) + 1)


def tree(rows, bins, depth):
    """{bin: value} of a tree over (bin, gradient, weight) rows: the cut between bins with the largest gain, while it gains."""
    gain = lambda part: sum(g for _, g, _ in part) ** 2 / (sum(h for _, _, h in part) + 1)
    if depth and len(bins) > 1:
        best = max(range(1, len(bins)), key=lambda k: (round(gain([r for r in rows if r[0] in bins[:k]]) + gain([r for r in rows if r[0] in bins[k:]]), 12), -k))
        left, right = ([r for r in rows if r[0] in part] for part in (bins[:best], bins[best:]))
        if gain(left) + gain(right) > gain(rows) + 1e-9:
            return tree(left, bins[:best], depth - 1) | tree(right, bins[best:], depth - 1)
    return dict.fromkeys(bins, leaf(rows))


def plain_gam(x, y):
    """Every row's log-odds, from the definition, row by row."""
    n, width = x.shape
    total = [math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))] * n
    cuts = lambda v, k: sorted(set(np.quantile(v, [j / k for j in range(1, k)]).tolist()))
    bin_of = lambda v, c: sum(v >= t for t in c)
    fine = [cuts(x[:, f], q.BINS) for f in range(width)]
    coarse = [cuts(x[:, f], q.COARSE) for f in range(width)]

    def gradients():
        p = [1 / (1 + math.exp(-t)) for t in total]
        return [(b - a, a * (1 - a)) for a, b in zip(p, y, strict=True)]

    for _ in range(q.ROUNDS):
        for f in range(width):
            bins = [bin_of(v, fine[f]) for v in x[:, f]]
            step = tree([(b, g, h) for b, (g, h) in zip(bins, gradients(), strict=True)], list(range(len(fine[f]) + 1)), 2)
            total = [t + q.RATE * step[b] for t, b in zip(total, bins, strict=True)]
    small = [[bin_of(v, coarse[f]) for v in x[:, f]] for f in range(width)]
    found = []
    for i in range(width):
        for j in range(i):
            cells = {}
            for k, (g, h) in enumerate(gradients()):
                a, b = cells.get((small[i][k], small[j][k]), (0, 0))
                cells[small[i][k], small[j][k]] = a + g, b + h
            found.append((sum(a * a / (b + 1) for a, b in cells.values()), i, j))
    pairs = sorted(found, reverse=True)[: q.PAIRS]
    for _ in range(q.ROUNDS // 4):
        for _, i, j in pairs:
            g = gradients()
            rows = tree([(small[i][k], *g[k]) for k in range(n)], list(range(len(coarse[i]) + 1)), 1)
            step = {}
            for value in set(rows.values()):
                part = [k for k in range(n) if rows[small[i][k]] == value]
                columns = tree([(small[j][k], *g[k]) for k in part], list(range(len(coarse[j]) + 1)), 1)
                step |= {(a, b): v for a, r in rows.items() if r == value for b, v in columns.items()}
            total = [t + q.RATE * step[small[i][k], small[j][k]] for k, t in enumerate(total)]
    return total, {(i, j) for _, i, j in pairs}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_boosting_is_its_plain_version(monkeypatch, seed):
    for name, value in (("BINS", 6), ("COARSE", 4), ("ROUNDS", 8), ("PAIRS", 2)):
        monkeypatch.setattr(q, name, value)
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=90), rng.integers(0, 3, 90), rng.random(90), rng.normal(size=90)])
    y = ((x[:, 0] * x[:, 3] + 0.3 * x[:, 1] + rng.normal(0, 0.2, 90)) > 0.2).astype(float)
    model = q.Gam(x, y)
    want, pairs = plain_gam(x, y)
    assert model.score(x) == pytest.approx([1 / (1 + math.exp(-t)) for t in want], abs=1e-9)
    assert {(i, j) for i, j, *_ in model.pairs} == pairs


def plain_features(text):
    w, size = re.findall(r"[^\x20\x09-\x0D]+", text), len(text.encode())
    data = text.encode()
    share = lambda chars: sum(c in chars for c in data) / max(1, size)
    each, grams = max(1, len(w)), [tuple(w[k : k + 4]) for k in range(len(w) - 3)]
    return [
        math.log1p(len(w)), sum(len(v.encode()) for v in w) / each, share(b"#*$%&<>"), share(bytes(range(65, 91))), share(b"!"), share(b"|"), sum(a == b for a, b in zip(w, w[1:], strict=False)) / each, len(set(w)) / each,
        share(b"0123456789"), share(b"\n"), share(b".,;:"), len(set(grams)) / max(1, len(grams)), share(bytes(range(128, 256))), sum("A" <= v[0] <= "Z" for v in w) / each,
    ]


def test_features_are_their_definitions():
    rng = random.Random(3)
    texts = ["", " ", "\n", "a", "A a a A!", "é ß | # 12, x.y\nZ"] + ["".join(rng.choices("aAbé 1|!#.\n\t", k=rng.randint(1, 300))) for _ in range(60)]
    got = q.features([t.encode() for t in texts])
    for row, t in zip(got, texts, strict=True):
        assert row.tolist() == pytest.approx(plain_features(t), abs=1e-12), t
