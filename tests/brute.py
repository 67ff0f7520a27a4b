"""Plain Python definitions the column expressions are tested against."""

import re
import string
from collections import Counter

from scoreloom.functions.porter import stem


def normalize(text):
    bare = text.lower().translate(str.maketrans("", "", string.punctuation))
    return re.sub(r"\s+", " ", bare).strip()


def f_measure(p, r):
    return 2 * p * r / (p + r) if p + r > 0 else 0.0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        above = row[:]
        for j, y in enumerate(b):
            row[j + 1] = above[j] + 1 if x == y else max(above[j + 1], row[j])
    return row[-1]


def rouge(prediction, reference, stemmed):
    def tokens(text):
        words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
        return [stem(w) for w in words] if stemmed else words

    a, b = tokens(prediction), tokens(reference)
    scores = {}
    for n in (1, 2):
        ga, gb = (Counter(zip(*(t[i:] for i in range(n)))) for t in (a, b))
        hits, na, nb = sum((ga & gb).values()), sum(ga.values()), sum(gb.values())
        scores[f"rouge_{n}"] = f_measure(hits / max(na, 1), hits / max(nb, 1))
    hits = lcs(a, b)
    scores["rouge_l"] = f_measure(hits / len(a), hits / len(b)) if a and b else 0.0
    return scores


def overlap(prediction, reference):
    a, b = normalize(prediction).split(), normalize(reference).split()
    shared = len(set(a) & set(b))
    p = shared / len(set(a)) if a and b else 0.0
    r = shared / len(set(b)) if b else 0.0
    copies = sum((Counter(a) & Counter(b)).values())
    similar = copies / (len(a) * len(b)) ** 0.5 if a and b else 0.0
    return {"precision": p, "recall": r, "f1": f_measure(p, r), "semantic_similarity": similar}


def quantile(values, p, interpolate=True):
    values = sorted(values)
    position = p * (len(values) - 1)
    low = int(position)
    if not interpolate:
        return values[low]
    high = min(low + 1, len(values) - 1)
    return values[low] + (values[high] - values[low]) * (position - low)
