"""Operators on documents against brute force, with odd rows, repeated rows and empty tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from scoreloom.llm import bpe, mixing, quality, repeats, sharding, simhash, tokenstore, toxicity
from tests.llm.conftest import make

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def bag(rows):
    return collections.Counter(map(tuple, rows))


# Quality rules


def test_base_counts_equal_brute_force(docs, rows):
    trusted = docs.where("doc_id % 2 = 1").select("doc_id")
    found = quality.judge(docs, quality.ratios(docs, trusted)).collect()
    want = []
    for i, text, *_ in rows:
        w = words(text)
        windows = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        inside = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [line for line in (text or "").split("\n") if words(line)]
        failed = len(w) < 10 or 100 * len(inside) > 20 * len(w)
        symbols = sum(c in "#*$%&|<>" for c in text or "")
        want.append((i, len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(inside), failed))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert bag([r[n] for n in names] for r in found) == bag(want)
    assert not any(r["kept"] and r["base_failed"] for r in found)


def test_ratio_scores_equal_a_plain_count(spark):
    texts = [(1, "good stone good ring"), (2, "bad bad moon"), (3, "good moon"), (4, None), (5, "")]
    docs = make(spark, texts)
    ratios = quality.ratios(docs, docs.where("doc_id IN (1, 3)").select("doc_id"))
    size = 1 << quality.BITS

    def grams(text):
        h = [xxhash.xxh64_intdigest(w.encode()) for w in words(text)]
        pairs = [(a * 0x9FB21C651E98DF25 % 2**64) ^ b for a, b in zip(h, h[1:])]
        return [x * 0x9E3779B97F4A7C15 % 2**64 >> (64 - quality.BITS) for x in h + pairs]

    corpus, target = np.zeros(size), np.zeros(size)
    for i, text in texts:
        for g in grams(text):
            corpus[g] += 1
            target[g] += i in (1, 3)
    base = (corpus + 1) / (corpus + 1).sum()
    log = np.log((target + base * size) / (target.sum() + size) / base)
    got = {r["doc_id"]: r["score"] for r in quality.judge(docs, ratios).collect()}
    for i, text in texts:
        g = grams(text)
        assert got[i] == pytest.approx(np.mean(log[g]) if g else 0.0, abs=1e-5)
    assert got[1] > got[2]


def test_quality_without_trusted_or_rows(docs, none):
    assert not quality.ratios(docs, docs.where("false").select("doc_id")).any()
    assert quality.judge(none, quality.ratios(none, none.select("doc_id"))).count() == 0


# Byte-level BPE


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def test_bpe_equals_tiktoken_and_decodes(docs, rows, ranks):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    decoded = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks).collect()
    want = [(i, np.array(own.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t, *_ in rows]
    assert bag((r[0], bytes(r[1]), bytes(r[2])) for r in decoded) == bag(want)


def test_bpe_of_an_empty_table(none, ranks):
    assert bpe.encode(none, ranks, public_tokenizers.PATTERN).count() == 0


def test_long_pieces_merge_like_short_ones(ranks, monkeypatch):
    pieces = [b"internationalisation" * 3, "ñandú".encode() * 9, b" " * 63, bytes(range(60)), b"abababababab"]
    long = [bpe._merge_long(p, ranks) for p in pieces]
    assert long == [bpe.merge(p, ranks) for p in pieces]


# Toxicity


def labelled(spark, n=240):
    docs = [(i, f"plain words number w{i} " * 5 + ("you idiot " if i % 4 == 0 else "my friend ") + "end") for i in range(n)]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(n)] + [(None, 1, 1), (3, 1, None), (5, 1, 0)]
    return make(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_is_learned_and_held_out(spark, docs, rows):
    seen, labels = labelled(spark)
    model = toxicity.train(seen, labels)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(seen, model).collect()}
    held = [i for i in scores if zlib.crc32(str(i).encode()) % 3 == 1]
    assert min(scores[i] for i in held if i % 4 == 0) > max(scores[i] for i in held if i % 4)
    assert len(model.weights) < 2000
    odd = toxicity.score(docs, model).collect()
    assert len(odd) == len(rows) and all(0 <= r["score"] <= 1 for r in odd)
    kept = toxicity.drop_toxic(seen, model)
    assert kept.columns == seen.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {i for i in scores if scores[i] < 0.7}


def test_held_out_labels_do_not_matter(spark):
    seen, labels = labelled(spark)
    flipped = labels.withColumn("toxic", F.when(toxicity.remainder() == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(seen, labels), toxicity.train(seen, flipped)
    assert (a.at == b.at).all() and (a.weights == b.weights).all() and a.bias == b.bias


def test_toxicity_without_labels(spark, docs, none):
    _, labels = labelled(spark, 4)
    model = toxicity.train(docs, labels.where("false"))
    assert max(r["score"] for r in toxicity.score(docs, model).collect()) < 0.01
    assert toxicity.score(none, model).count() == 0 and toxicity.drop_toxic(none, model).count() == 0


# Token store


def test_token_store_equals_the_library(spark, docs, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    encoded = [
        (i, np.array(own.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for i, t, *_ in rows
    ]
    store = tokenstore.write_store(docs, open(path).read(), 49_408, 2)
    found = tokenstore.read_ids(spark, store, docs.select("doc_id")).collect()
    assert bag((r["doc_id"], bytes(r["ids"])) for r in found) == bag(encoded)
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in found)
    at = 0
    for r in sorted(found, key=lambda r: (r["start"])):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(found, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda i: -1 if i is None else i)
    absent = spark.createDataFrame([(10**9,), (701,)], "doc_id long")
    assert [r["doc_id"] for r in tokenstore.read_ids(spark, store, absent).collect()] == [701]


@pytest.mark.parametrize("hot", [5, None])
def test_a_hot_id_fills_many_parts(spark, hot):
    """A third of all rows under one id, or none, equal texts among them: split, in order, and every row found."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    rows = [(hot, "the same row") if k % 2 else (hot, f"row {k}") for k in range(300)] + [(k, f"text {k}") for k in range(600)]
    docs = make(spark, rows).repartition(4).cache()
    store = tokenstore.write_store(docs, open(path).read(), 49_408, 2, part_bytes=400)
    blocks = spark.table(store.blocks).select("part", "doc_ids", "turns").collect()
    sizes = {}
    for b in blocks:
        sizes[b["part"]] = sizes.get(b["part"], 0) + len(b["doc_ids"]) // 8
    assert max(sizes.values()) < 120
    found = tokenstore.read_ids(spark, store, docs.select("doc_id")).collect()
    wanted = ((i, np.array(own.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes()) for i, t in rows)
    assert bag((r["doc_id"], bytes(r["ids"])) for r in found) == bag(wanted)
    ordered = sorted(found, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == [sum(x["n_tokens"] for x in ordered[:k]) for k in range(len(ordered))]
    keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in ordered]
    assert keys == sorted(keys)
    twice = spark.createDataFrame([(hot,)] * 2, "doc_id long")
    assert tokenstore.read_ids(spark, store, twice).count() == 2


def test_token_store_of_an_empty_table(spark, none):
    store = tokenstore.write_store(none, open(public_tokenizers.path("word_bpe_49k.json")).read(), 49_408, 2)
    assert tokenstore.read_ids(spark, store, none.select("doc_id")).count() == 0


def test_special_strings_and_marks_encode_like_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    texts = ["A <|endoftext|>b <|ENDOFTEXT|> İstanbul, ΣΑΣ. it's... «x»! 'S 12,5. é\u0301, ﬁn;", "a\x1cb \x85 c\u2003d.", "x,,y.,"]
    texts += ["straße ñandú, ÿþæ ß. ÷ µm ªº éa\u0301e naïve×3 ÀÉÎÕÜ soldier's can't"]
    texts += [" ".join(chr(c) + "a" + chr(c + 1) for c in range(0x80, 0x250))]
    got = tokenstore._Encoder(open(path).read(), 2).encode([t.encode() for t in texts])
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [own.encode(t, add_special_tokens=False).ids for t in texts]


def test_forms_of_a_word_are_learned_once_and_memory_is_bounded(monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    encoder = tokenstore._Encoder(open(path).read(), 2)
    texts = ["Stone stone, STONE. stone!? stone) stone### Stone*", " Stone's stone' É É. \t", "H\u0331. \u212a, a_b_ \u00c9\u0301; '", ""]
    got = encoder.encode([*(t.encode() for t in texts), None, b"\xc3 a\xff, \xcc"])
    wanted = [*texts, "", b"\xc3 a\xff, \xcc".decode("utf-8", "replace")]
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [own.encode(t, add_special_tokens=False).ids for t in wanted]
    assert sum(w.lower().startswith(b"stone") for w in encoder.words) == 2  # stone, stone's
    monkeypatch.setattr(tokenstore, "MEMO", 100)
    for k in range(30):
        row = " ".join(f"often {chr(97 + j % 26)}{chr(97 + k % 26)}word{chr(97 + j // 26)}," for j in range(40))
        assert np.frombuffer(encoder.encode([row.encode()])[0], "<u2").tolist() == own.encode(row, add_special_tokens=False).ids
    assert len(encoder.words) <= 50 + 41 and len(encoder.older) <= 50 + 41 and b"often" in encoder.words


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    slots = tokenstore.PerfectHash.over(np.unique(keys)).slots(np.unique(keys))
    assert sorted(slots) == list(range(len(np.unique(keys))))
    assert len(tokenstore.PerfectHash.over(np.empty(0, np.uint64)).slots(keys)) == len(keys)


# Sharding


def test_shards_are_even_and_gapless(docs, rows):
    found = sharding.shard_by_bytes(docs, shards=4).collect()
    want = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows]
    assert bag((r[0], r[1], r[2]) for r in found) == bag(want)
    slots = collections.defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("same", ["text", "row"])
def test_a_hot_text_is_split_and_shards_stay_even(spark, same):
    rows = [(k if same == "text" else 7, "hot text of some words") for k in range(2000)]
    rows += [(5000 + k, f"text number {k:06d} here it is") for k in range(2000)]
    found = sharding.shard_by_bytes(make(spark, rows).repartition(4)).collect()
    sizes = collections.Counter()
    for r in found:
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) < 100


def test_small_groups_stay_together(spark):
    rows = [(k, f"text number {k // 3:06d} is what it is") for k in range(9000)]
    homes = collections.defaultdict(set)
    for r in sharding.shard_by_bytes(make(spark, rows).repartition(4)).collect():
        homes[r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in homes.values())


def test_sharding_an_empty_table(none):
    assert sharding.shard_by_bytes(none).count() == 0


# SimHash


def simhash_of(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(prints):
    """Smallest index each index reaches, links being three or fewer differing bits."""
    root = list(range(len(prints)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(a) for a in range(len(prints))]


def test_near_duplicates_equal_brute_force(docs, rows):
    prints = [simhash_of(t) for _, t, *_ in rows]
    groups = components_of(prints)
    least = {}
    for g, (i, *_) in zip(groups, rows):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    want = bag((i, p, least.get(g)) for (i, *_), p, g in zip(rows, prints, groups))
    found = simhash.near_duplicates(docs).collect()
    assert bag((r[0], r[1] % 2**64, r[2]) for r in found) == want


@pytest.mark.parametrize("hot", [64, 3])
def test_links_of_dense_fingerprints(spark, monkeypatch, hot):
    """Hundreds of fingerprints around a few centres, with ordinary keys and with hot ones in blocks."""
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "BLOCK", 50)
    rnd = np.random.default_rng(5)
    prints = set()
    for centre in rnd.integers(0, 2**63, 6).tolist():
        for _ in range(60):
            x = centre
            for bit in rnd.choice(64, rnd.integers(0, 6), replace=False).tolist():
                x ^= 1 << bit
            prints.add(x)
    prints = sorted(prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    groups = components_of(prints)
    fps = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = simhash.connected_components(simhash.linked_pairs(fps)).collect()
    got = {r["node"]: r["component"] for r in found}
    by_group = collections.defaultdict(set)
    for p, g in zip(signed, groups):
        by_group[g].add(got.get(p, p))
    assert all(len(c) == 1 for c in by_group.values()) and len(set().union(*by_group.values())) == len(by_group)


def test_drop_near_duplicates_keeps_one_of_each_group(docs, none):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    found = simhash.near_duplicates(docs).where("doc_id IS NOT NULL").collect()
    assert {r["doc_id"] for r in kept.collect()} - {None} == {r["component_id"] for r in found}
    assert len(found) > kept.count()
    assert simhash.near_duplicates(none).count() == 0 and simhash.drop_near_duplicates(none).count() == 0


def test_pipeline_stage_is_simhash_by_its_contract(spark, docs, none):
    kept = corpus_pipeline.drop_copies(spark, docs, "")
    assert kept.columns == docs.columns and (simhash.SHINGLE, simhash.DISTANCE) == (3, 3)
    assert bag(kept.collect()) == bag(simhash.drop_near_duplicates(docs).collect())
    assert corpus_pipeline.drop_copies(spark, none, "").count() == 0


def test_rows_that_share_an_id_are_dropped_one_by_one(spark):
    passage, other = " ".join(f"p{k}" for k in range(30)), " ".join(f"q{k}" for k in range(30))
    rows = [(3, passage), (7, passage), (7, other), (7, other), (None, passage), (None, "alone " + other[:50]), (9, None), (9, ""), (8, "")]
    kept = simhash.drop_near_duplicates(make(spark, rows))
    assert bag((r["doc_id"], r["text"]) for r in kept.collect()) == bag([(3, passage), (7, other), (None, "alone " + other[:50]), (8, "")])


# Substring dedup


def without_repeats(rows):
    first = {}
    for i, text, *_ in rows:
        w = words(text)
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            if i is not None:
                first[key] = min(i, first.get(key, i))
    for i, text, *_ in rows:
        w = words(text)
        gone = set()
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        yield i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)


@pytest.mark.parametrize("per_bucket, chunk", [(1 << 20, 8 << 20), (700, 4000)])
def test_repeats_equal_brute_force(docs, rows, monkeypatch, per_bucket, chunk):
    monkeypatch.setattr(repeats, "PER_BUCKET", per_bucket)
    want = [(i, n, gone, hashlib.sha256(left.encode()).hexdigest()) for i, n, gone, left in without_repeats(rows)]
    found = repeats.find_repeats(docs, chunk=chunk).drop("kept", "mark").collect()
    assert sum(w[2] for w in want) > 300
    assert bag(found) == bag(want)


def test_a_repeated_id_around_another_document(spark):
    """Rows 1, 2, 1 in one chunk share a passage that no other chunk has."""
    passage = " ".join(f"p{k}" for k in range(20))
    frame = make(spark, [(1, passage), (2, f"x {passage} y"), (1, passage)]).coalesce(1)
    found = repeats.find_repeats(frame).collect()
    assert bag((r["doc_id"], r["n_removed"]) for r in found) == bag([(1, 0), (1, 0), (2, 20)])


def test_drop_repeats_changes_only_what_lost_words(docs, rows, none):
    out = repeats.drop_repeats(docs)
    assert out.columns == docs.columns
    left = {i: (gone, text) for i, _, gone, text in without_repeats(rows)}
    for r in out.collect():
        gone, text = left[r["doc_id"]]
        if gone:
            assert r["text"] == text and r["n_chars"] == len(text)
    assert out.count() == len(rows)
    assert repeats.find_repeats(none).count() == 0 and repeats.drop_repeats(none).count() == 0


def test_rows_that_share_an_id_lose_their_own_words(spark):
    passage = " ".join(f"p{k}" for k in range(20))
    rows = [(1, passage), (7, "alone and not to be touched"), (7, f"x {passage} y"), (7, f"x {passage} y"), (7, f"{passage}\nz"), (7, None)]
    out = repeats.drop_repeats(make(spark, rows).repartition(3))
    want = [(1, passage), (7, "alone and not to be touched"), (7, "x y"), (7, "x y"), (7, "z"), (7, None)]
    assert bag((r["doc_id"], r["text"]) for r in out.collect()) == bag(want)


# Mixing


def test_budgets_fill_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame(
        [("d1", "en", "a", 10), ("d1", "en", "b", 1000), ("d1", "de", "c", 5), ("d2", "en", "e", 1000), ("d3", "en", "f", 20)],
        "domain string, lang string, source string, tokens long",
    )
    got = {r["source"]: r["budget"] for r in mixing.budgets(leaves, {}, 620, 1).collect()}
    # d3 has only 20, so d1 and d2 share 600; in d1, de has 5 and en takes the rest; a has 10, b takes on.
    assert got == {"a": 10, "b": 285, "c": 5, "e": 300, "f": 20}
    weighted = {r["source"]: r["budget"] for r in mixing.budgets(leaves, {"d2": 3.0}, 420, 1).collect()}
    assert weighted == {"a": 10, "b": 85, "c": 5, "e": 300, "f": 20}


def test_mix_takes_prefixes_of_whole_epochs(docs, rows, monkeypatch, none):
    monkeypatch.setattr(mixing, "PER_BUCKET", 3)
    found = mixing.select_mix(docs, {"de": 5.0}, budget=1.0).collect()
    spent = collections.Counter()
    for r in found:
        spent[(r["domain"], r["lang"], r["source"], r["leaf_budget"])] += r["n_tokens"]
    assert all(tokens <= leaf[3] for leaf, tokens in spent.items())
    times = collections.Counter((r["doc_id"], r["n_tokens"]) for r in found if r["epoch"] == 0)
    there = collections.Counter((i, len(words(t))) for i, t, *_ in rows)
    assert all(n <= there[k] for k, n in times.items())
    out = mixing.mixed(docs, {"de": 5.0}, budget=0.5, max_epochs=1)
    assert out.columns == docs.columns and 0 < out.count() < len(rows)
    assert mixing.select_mix(none, {}).count() == 0 and mixing.mixed(none, {}).count() == 0


def test_rows_that_share_an_id_are_taken_one_by_one(spark):
    rows = [(7, "a b c"), (7, "a b c d e f"), (1, "a"), (None, "x y"), (None, "x y"), (7, None)] + [(5, "q q q q")] * 6
    docs = make(spark, rows).repartition(3)
    for budget, epochs in ((0.5, 1), (1.0, 1), (0.7, 2), (1.7, 2)):
        taken = mixing.select_mix(docs, {}, budget=budget, max_epochs=epochs).collect()
        out = mixing.mixed(docs, {}, budget=budget, max_epochs=epochs).collect()
        assert bag((r["doc_id"], len(words(r["text"]))) for r in out) == bag((r["doc_id"], r["n_tokens"]) for r in taken)
        assert sum(len(words(r["text"])) for r in out) <= budget * sum(len(words(t)) for _, t in rows)
