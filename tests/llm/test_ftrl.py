"""The toxicity model's optimiser against a plain one: dictionaries, one coordinate at a time."""

import collections
import math
import random

import numpy as np
import pytest
import xxhash

from scoreloom.llm import toxicity as t

MASK = (1 << 64) - 1


def features(text):
    words = [w.strip(t.EDGES) or w for w in text.lower().split()]
    whole = [xxhash.xxh64_intdigest(w, 0) for w in words]
    found = whole + [xxhash.xxh64_intdigest(w.decode("utf-8", "replace")[: t.PREFIX].encode(), 1) for w in words]
    for gap, factor in ((1, 0x9FB21C651E98DF25), (2, 0xD6E8FEB86659FD93)):
        found += [(a * factor & MASK) ^ b for a, b in zip(whole, whole[gap:])]
    count = collections.Counter((x * 0x9E3779B97F4A7C15 & MASK) >> (64 - t.BITS) for x in found)
    return {k: min(c * t.SPREAD / max(len(words), t.SPREAD), t.CAP) for k, c in count.items()}


def plain_ftrl(texts, labels):
    rows = [features(x) for x in texts]
    seen = collections.Counter(k for row in rows for k in row)
    z, n, bias_z, bias_n = collections.defaultdict(float), collections.defaultdict(float), 0.0, 0.0

    def weight(k):
        if abs(z[k]) <= t.L1:
            return 0.0
        return (math.copysign(t.L1, z[k]) - z[k]) / ((t.BETA + math.sqrt(n[k])) / t.ALPHA + t.L2)

    for _ in range(t.EPOCHS):
        for row, y in zip(rows, labels):
            x = {k: v for k, v in row.items() if seen[k] > 1}
            w = {k: weight(k) for k in x}
            bias = -bias_z / ((t.BETA + math.sqrt(bias_n)) / t.ALPHA)
            error = 1 / (1 + math.exp(-(sum(w[k] * v for k, v in x.items()) + bias))) - y
            for k, v in x.items():
                g = error * v
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / t.ALPHA * w[k]
                n[k] += g * g
            bias_z += error - (math.sqrt(bias_n + error * error) - math.sqrt(bias_n)) / t.ALPHA * bias
            bias_n += error * error
    return {k: weight(k) for k in z if weight(k)}, -bias_z / ((t.BETA + math.sqrt(bias_n)) / t.ALPHA)


def test_weights_equal_a_plain_optimiser():
    rnd = random.Random(2)
    words = ["friend", "stone,", "You", "idiot!", "stupid", "fool", "ñandú", "(moon)", "...", "ringing", "rings"] + [f"w{k}" for k in range(40)]
    labels = [rnd.random() < 0.4 for _ in range(160)]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.choice([0, 3, 30, 90]))) + (" you idiot " * rnd.choice([1, 2]) if y else " my friend") for y in labels]
    texts = [x.encode() for x in texts]
    at, weights, bias = t._fit(texts, np.array(labels, float))
    want, want_bias = plain_ftrl(texts, labels)
    assert set(at.tolist()) == set(want) and 5 < len(want) < 400
    assert dict(zip(at.tolist(), weights.tolist())) == pytest.approx(want, rel=1e-3, abs=1e-4)
    assert bias == pytest.approx(want_bias, rel=1e-3)
    # What was learned tells the two kinds apart, and no text at all has a score too.
    scores = t.ToxicityModel(at, weights, bias).scores([b"you idiot", b"my friend", b"", None])
    assert scores[0] > scores[1] and scores[2] == scores[3] == pytest.approx(1 / (1 + math.exp(-bias)))
