"""Hard negatives, spelling variants and decontamination against brute force, with odd rows and empty tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from scoreloom.llm import decontamination, negatives, spelling
from tests.llm.conftest import make


def bag(rows):
    return collections.Counter(map(repr, map(tuple, rows)))


# Hard negatives


def mined(rows, is_anchor, window=(30, 90), scale=256):
    """All scores of all pairs, in Python's own whole numbers."""
    sound = []
    for n, (i, e, label) in enumerate(rows):
        if i is not None and label is not None and e is not None and None not in e and np.isfinite(e).all():
            q = [int(np.floor(scale * float(x))) for x in e]
            if sum(x * x for x in q) < 2**62:
                sound.append((n, i, label, q))
    for n, i, label, q in sound:
        if not is_anchor(i):
            continue
        others = sorted(
            ((-sum(x * y for x, y in zip(q, p)), j, other == label) for m, j, other, p in sound if m != n and len(p) == len(q)),
            key=lambda r: r[:2],
        )
        for score, positive in [(-s, j) for s, j, same in others if same][:5]:
            fits = [(-s, j) for s, j, same in others if not same and window[0] * score <= -100 * s <= window[1] * score]
            for rank, (s, j) in enumerate(fits[:10]):
                yield i, positive, rank + 1, j, score, s


def odd_vectors():
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(6, 12))
    x = (centres[rnd.integers(0, 6, 300)] + 0.4 * rnd.normal(size=(300, 12))).astype(np.float32)
    rows = [(k, [float(v) for v in x[k]], int(rnd.integers(0, 5))) for k in range(300)]
    rows += [(300 + k, rows[k % 3][1], rows[k % 3][2]) for k in range(60)]  # many equal vectors: ties
    rows += [(500, [0.0] * 12, 1), (510, None, 1), (520, [None] + [1.0] * 11, 1), (530, [float("nan")] * 12, 2)]
    rows += [(540, [float("inf")] * 12, 1), (550, rows[0][1], None), (None, rows[0][1], 1), (560, [], 0), (570, [], 1)]
    rows += [(580, [1.0, 2.0], 0), (590, [2.0, 1.0], 1), (591, [1.0, 0.5], 0), (600, [1e30] * 12, 0), (610, [3e6] * 12, 1), (611, [2.9e6] * 12, 1)]
    rows += [(612, [1.5e6] * 12, 2), (613, [2e6] * 12, 3), (10, rows[11][1], 3), (20, rows[20][1], rows[20][2]), rows[7]]
    return rows


@pytest.mark.parametrize("block, pairs", [(2048, 1 << 20), (5, 64)])
def test_negatives_equal_brute_force(spark, monkeypatch, block, pairs):
    monkeypatch.setattr(negatives, "ANCHORS", block)
    monkeypatch.setattr(negatives, "PAIRS", pairs)
    rows = odd_vectors()
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, rank string, row int")
    found = negatives.hard_negatives(frame.repartition(5), frame["vec_id"] % 10 == 0)
    want = list(mined(rows, lambda i: i % 10 == 0))
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert bag(found.collect()) == bag(want) and len(want) > 500


def test_bounds_hold_and_leave_out_most_pairs(spark):
    """Every score lies in its bounds; among clustered vectors few pairs are scored."""
    rnd = np.random.default_rng(9)
    centres = rnd.normal(size=(8, 24))
    q = np.floor(256 * (centres[rnd.integers(0, 8, 2000)] + 0.05 * rnd.normal(size=(2000, 24))))
    q[0] = q[1] = 3 * q[2]
    q[3] = 0
    references, norms = negatives.pick_references(q, 8), negatives._norms(q)
    block = negatives.Block(np.arange(2000), np.arange(2000), rnd.integers(0, 8, 2000), q.astype(np.int32), norms, negatives._angles(q, norms, references))
    low, high = negatives.bounds(block.part(slice(50)), block)
    exact = q[:50] @ q.T
    assert (low <= exact).all() and (exact <= high).all()
    # Without angles a score could be anything between plus and minus the product of the norms.
    assert (high - low).mean() < 0.5 * (2 * norms[:50, None] * norms[None, :]).mean()
    search = negatives.Positives(block.part(slice(50)), 5)
    search.add(block)
    assert search.scored < 0.6 * 50 * 2000 / 8


def test_no_vectors_or_anchors(spark):
    frame = spark.createDataFrame(odd_vectors(), "vec_id long, embedding array<double>, label int")
    for empty in (negatives.hard_negatives(frame.where("false"), frame["vec_id"] > 0), negatives.hard_negatives(frame, frame["vec_id"] < 0)):
        assert empty.count() == 0
    assert negatives.hard_negatives(frame.where("label = 1"), frame["vec_id"] % 10 == 0).count() == 0


# Spelling


def counted(rows, dropped=97):
    n = collections.Counter()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % dropped == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return n


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants(vocabulary):
    links = {w: [v for v in vocabulary if near(w, v)] for w in vocabulary}
    forms = {}
    for w, n in vocabulary.items():
        best = min(links[w], key=lambda v: (-vocabulary[v], v), default=None)
        forms[w] = best if best and vocabulary[best] >= 2 * n else None
    for w, n in vocabulary.items():
        root = w
        while forms[root]:
            root = forms[root]
        yield w, forms[w], root, n, len(links[w]), vocabulary[forms[w]] if forms[w] else None


def test_word_counts_equal_brute_force(docs, rows):
    got = {r["word"]: r["n"] for r in spelling.count_words(docs, dropped=7).collect()}
    want = counted(rows, 7)
    assert got == {w: n for w, n in want.items() if w} and "ñand" in "".join(got)


def dense_words(seed, n, letters, lengths):
    """Words that share grams and differ by little, with counts that make chains of forms."""
    rnd = random.Random(seed)
    words = {}
    parts = ["".join(rnd.choice(letters) for _ in range(rnd.choice([2, 3, 4]))) for _ in range(12)]
    while len(words) < n:
        w = "".join(rnd.choice(parts) for _ in range(rnd.choice(lengths)))
        at = rnd.randrange(len(w))
        for v in (w, w[:at] + rnd.choice(letters) + w[at + 1 :], w[:at] + w[at + 1 :], w[:at] + rnd.choice(letters) + w[at:], w + w[-1], w[0] + w):
            if len(v) >= 5:
                words[v] = 3 * 2 ** rnd.randrange(9) + rnd.randrange(3)
    return words


@pytest.mark.parametrize("places, longest, hot", [(4096, 5, 4096), (30, 5, 4096), (200, 8, 4), (1, 3, 3)])
def test_variants_equal_brute_force(spark, monkeypatch, places, longest, hot):
    """Dictionaries of many sizes, down to none, and lists that are dealt out."""
    monkeypatch.setattr(spelling, "HOT", hot)
    vocabulary = dense_words(places, 350, "abcdé", [2, 3, 4]) | dense_words(longest, 60, "xyÿ", [1, 2])
    vocabulary |= {"z" * 400 + "q" * 300: 9, "z" * 401 + "q" * 300: 20, "z" * 401 + "q" * 299: 3, "aaaaa": 4, "aaaaaa": 8, "aaaaaaa": 16}
    frame = spark.createDataFrame(list(vocabulary.items()), "word string, n long")
    found = spelling.group_variants(frame.repartition(4), places=places, longest=longest).collect()
    want = list(variants(vocabulary))
    assert bag(found) == bag(want)
    assert sum(w[4] for w in want) > 500 and any(w[2] not in (w[0], w[1]) for w in want)


def test_unaffected_grams_are_shared():
    """What `entries` promises: near words share a listed gram at its place, or a remainder."""
    words = dense_words(3, 300, "abcd", [2, 3])
    counts = collections.Counter(w[a : a + k] for w in (spelling.BEGIN + w + spelling.END for w in words) for k in (2, 3, 4) for a in range(len(w) - k + 1))
    book = spelling.Dictionary({g: n for g, n in counts.items() if n > 25})
    entries = {w: book.entries(w) for w in words}
    bound = 0
    for w in words:
        for v in words:
            if w < v and near(w, v):
                a, b = sorted((w, v), key=len)
                steps = (0,) if len(a) == len(b) else (0, 1)
                met = {(g, at + k) for g, at in entries[a][0] for k in steps} & set(entries[b][0])
                bound += not met
                assert met or set(entries[a][1]) & set(entries[b][1]), (w, v)
    assert bound < 200


def test_spelling_of_documents(docs, rows, none):
    vocabulary = {w: n for w, n in counted(rows).items() if len(w) >= 5 and n >= 3}
    assert bag(spelling.spelling_variants(docs).collect()) == bag(variants(vocabulary))
    assert spelling.spelling_variants(none).count() == 0
    with pytest.raises(ValueError):
        spelling.group_variants(docs, ratio=1)


# Decontamination

TOKEN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    return TOKEN.findall((text or "").translate(LOW))


def contaminated(rows, items):
    grams = collections.defaultdict(set)
    for i, text, *_ in items:
        w = plain(text)
        z = min(10, len(w))
        for k in range(len(w) - z + 1 if w else 0):
            grams[tuple(w[k : k + z])].add(i)
    for doc_id, text, *_ in rows:
        w = plain(text)
        hit, found = set(), set()
        for z in {len(g) for g in grams}:
            for k in range(len(w) - z + 1):
                if (own := grams.get(tuple(w[k : k + z]))) is not None:
                    hit |= set(range(k, k + z))
                    found |= own
        yield doc_id, len(w), len(hit), sorted(str(i) for i in found if i is not None), sorted(hit)


def leaky():
    rnd = random.Random(6)
    word = lambda: rnd.choice(["Das", "the", "x9", "Élan", "ÉLAN", "wort", "ring"]) + str(rnd.randrange(40))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(k, text(rnd.choice([1, 3, 9, 10, 11, 30]))) for k in range(30)]
    items += [(40, None), (41, ""), (42, "!? ..."), (43, items[20][1]), (None, items[25][1] + " more"), (44, text(9000)), items[3], (-5, "one-word,here")]
    rows = []
    for k in range(80):
        body = text(rnd.choice([0, 5, 60]))
        if rnd.random() < 0.6:
            leak = rnd.choice(items)[1] or ""
            cut = leak.split(" ")
            at = rnd.randrange(max(1, len(cut) - 12))
            leak = rnd.choice([leak if len(leak) < 5000 else "", " ".join(cut[at : at + 14])])
            body += rnd.choice([" ", "... ", "\n-", "_"]) + leak.upper().replace(" ", rnd.choice([" ", ", ", "\t"])) + " " + text(4)
        rows.append((k, body))
    rows += [(100, None), (101, ""), (102, "\x00\x7f!"), (None, items[20][1]), (3, items[22][1]), rows[5], (103, items[35][1] + " end"), (104, text(20_000))]
    return rows, items


@pytest.mark.parametrize("block, segment", [(4 << 20, 4096), (600, 25)])
def test_contamination_equals_brute_force(spark, monkeypatch, block, segment):
    """One block of the benchmark, and many blocks of cut items that add to each other's finds."""
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block if block > 1000 else 12_000)
    monkeypatch.setattr(decontamination, "SEGMENT", segment)
    rows, items = leaky()
    docs = make(spark, rows).withColumnRenamed("n_words", "n_hit").repartition(4)
    benchmark = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, items string")
    found = decontamination.find_contamination(docs, benchmark).collect()
    want = list(contaminated(rows, items))
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"], [k for a, b in zip(r["hits"][0::2], r["hits"][1::2]) for k in range(a, b)]) for r in found]
    assert bag(got) == bag(want) and sum(bool(w[4]) for w in want) > 30
    assert bag((r["doc_id"], r["n_items"]) for r in found) == bag((w[0], len(w[3])) for w in want)


def test_contaminated_documents_or_spans_go(spark, docs, none):
    rows, items = leaky()
    frame = make(spark, rows)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = list(contaminated(rows, items))
    kept = decontamination.drop_contaminated(frame, benchmark)
    assert kept.columns == frame.columns and bag((r["doc_id"], r["text"]) for r in kept.collect()) == bag((r[0], r[1]) for r, w in zip(rows, want) if not w[4])
    cut = decontamination.cut_contaminated(frame, benchmark)
    assert cut.schema == frame.schema
    left = bag((r["doc_id"], plain(r["text"])) for r in cut.collect())
    assert left == bag((w[0], [x for k, x in enumerate(plain(t)) if k not in w[4]]) for (_, t, *_), w in zip(rows, want))
    whole = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert whole[100] is None and whole[102] == "\x00\x7f!"
    for nothing in (benchmark.where("false"), benchmark.where("item_id IN (40, 41, 42)")):
        assert decontamination.drop_contaminated(docs, nothing).count() == docs.count()
        assert decontamination.find_contamination(docs, nothing).where("n_hit > 0 OR n_items > 0").count() == 0
    assert decontamination.find_contamination(none, benchmark).count() == 0 and decontamination.cut_contaminated(none, benchmark).count() == 0


def test_digest_of_items(spark):
    rows, items = leaky()
    found = decontamination.find_contamination(make(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    got = bag((r[0], r[1]) for r in found.selectExpr("doc_id", "sha2(concat_ws(',', items), 256)").collect())
    assert got == bag((w[0], hashlib.sha256(",".join(w[3]).encode()).hexdigest()) for w in contaminated(rows, items))
