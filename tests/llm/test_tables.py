"""Embeddings, pages, components, the pipeline, and the named queries against their SQL."""

import collections
import glob
import os
import re

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry_module
import corpus_pipeline
from scoreloom.llm import common, covertree, linkgraph
from scoreloom.llm.components import connected_components
from scoreloom.llm.queries import QUERIES, RULES, SQL
from tests.llm.conftest import make, random_rows


def test_components_of_paths_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(frame).collect()}
    want = {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)} | {200: 200, 201: 200}
    assert got == want
    assert connected_components(frame.where("false")).count() == 0


def vectors(seed, n, spread):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(max(1, n // 8), 16))
    x = centres[rnd.integers(0, len(centres), n)] + spread * rnd.normal(size=(n, 16))
    return x.astype(np.float32)


@pytest.mark.parametrize(("leaf", "by_centre"), [(1024, 8), (40, 8), (40, 1)])
def test_vector_links_equal_brute_force(spark, monkeypatch, leaf, by_centre):
    monkeypatch.setattr(covertree, "LEAF", leaf)
    monkeypatch.setattr(covertree, "BY_CENTRE", by_centre)
    x = vectors(1, 260, 0.1)
    x[5] = x[6] = x[7]
    x[8] = 3 * x[9]
    rows = [(k + 10, [float(v) for v in x[k]], k % 2) for k in range(len(x))]
    rows += [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [None] * 16, 0), (1003, [float("nan")] * 16, 1)]
    rows += [(1004, [float("inf")] + [1.0] * 15, 1), (1005, [], 0), (1006, rows[0][1], None), (1007, [1.0, 0.0], 0), (1008, [2.0, 0.0], 0)]
    rows += [(1009, [1e200] + [0.0] * 15, 0), (1010, [1e-200] + [0.0] * 15, 0)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, kept string")
    sound = [
        (i, np.array(e) / np.abs(e).max(), lab) for i, e, lab in rows
        if lab is not None and e and None not in e and np.isfinite(e).all() and np.any(e)
    ]
    links = collections.defaultdict(set)
    for i, e, lab in sound:
        for j, f, other in sound:
            if i != j and lab == other and len(e) == len(f) and e @ f / np.sqrt(e @ e) / np.sqrt(f @ f) >= 0.98:
                links[i].add(j)
    want = {}
    for i, *_ in rows:
        reach, stack = {i}, [i]
        while stack:
            for j in links[stack.pop()] - reach:
                reach.add(j)
                stack.append(j)
        want[i] = (len(links[i]), min(reach), min(reach) == i)
    found = covertree.near_duplicates(frame).collect()
    assert {r[0]: tuple(r[1:]) for r in found} == want and len(found) == len(rows)
    assert sum(n for n, *_ in want.values()) > 500


def test_vectors_that_cannot_be_divided_and_none(spark, monkeypatch):
    monkeypatch.setattr(covertree, "LEAF", 8)
    rows = [(k, [1.0, 1e-9 * k], 0) for k in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {tuple(r)[1:3] for r in covertree.near_duplicates(frame).collect()} == {(59, 0)}
    assert covertree.near_duplicates(frame.where("false")).count() == 0


def test_node_that_stays_too_large_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(covertree, "LEAF", 8)
    monkeypatch.setattr(covertree, "DEEPEST", 0)
    frame = spark.createDataFrame([(k, [1.0, float(k)], 0) for k in range(60)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(RuntimeError, match="too many"):
        covertree.near_duplicates(frame)


@pytest.mark.parametrize("reach_of_root", [0.7, 0.3])
def test_leaf_of_small_radius_is_pruned_by_its_levels(monkeypatch, reach_of_root):
    """Clusters around one direction: the root's radius is below 1, and inner levels still part them."""
    rnd = np.random.default_rng(5)
    away = rnd.normal(size=(64, 24))
    away *= 0.9 * reach_of_root / np.linalg.norm(away, axis=1, keepdims=True)
    away[:, 0] = 1
    x = np.repeat(away, 16, axis=0) + 0.002 * rnd.normal(size=(1024, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    threshold = 0.999
    reach = float(np.sqrt(2 - 2 * threshold))
    levels = covertree._levels(x, reach)
    assert levels[0][1][0] <= 1 and len(levels) >= 3
    radii = [level[1].max() for level in levels]
    assert radii == sorted(radii, reverse=True) and len(levels[-1][0]) == len(x)
    compared, whole = 0, np.einsum

    def counting(rule, a, b):
        nonlocal compared
        compared += len(a)
        return whole(rule, a, b)

    monkeypatch.setattr(covertree.np, "einsum", counting)
    found = {tuple(p) for pairs in covertree._descend(x, x, True, threshold) for p in pairs.tolist()}
    i, j = np.nonzero(np.triu(x @ x.T >= threshold, 1))
    assert found == set(zip(i.tolist(), j.tolist())) and len(found) > 1000
    assert compared < len(x) ** 2 / 8


def test_vectors_that_do_not_cluster_are_compared_in_blocks(monkeypatch):
    """One matrix product for a block of vectors, and no level of a node for each: pairs are not gathered one by one."""
    rnd = np.random.default_rng(6)
    x = rnd.normal(size=(2000, 32))
    x[1500:] = x[:500] + 0.02 * rnd.normal(size=(500, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    gathered, whole = 0, np.einsum

    def counting(rule, a, b):
        nonlocal gathered
        gathered += len(a)
        return whole(rule, a, b)

    monkeypatch.setattr(covertree.np, "einsum", counting)
    found = [tuple(p) for pairs in covertree._descend(x, x, True, 0.98) for p in pairs.tolist()]
    i, j = np.nonzero(np.triu(x @ x.T >= 0.98, 1))
    assert sorted(found) == sorted(zip(i.tolist(), j.tolist())) and len(found) >= 500
    assert gathered < 20 * len(x)


@pytest.mark.parametrize("seed", range(12))
def test_links_between_two_leaves_equal_brute_force(seed):
    rnd = np.random.default_rng(seed)
    width = int(rnd.integers(2, 12))
    centres = rnd.normal(size=(int(rnd.integers(1, 40)), width))

    def unit(n):
        x = centres[rnd.integers(0, len(centres), n)] + 10.0 ** rnd.uniform(-4, 0) * rnd.normal(size=(n, width))
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    a, b = unit(int(rnd.integers(1, 700))), unit(int(rnd.integers(1, 700)))
    for threshold in (0.5, 0.98, 0.99999):
        for same, other in ((True, a), (False, b)):
            cosines = np.einsum("id,jd->ij", a, other)
            wanted = cosines >= threshold
            if same:
                wanted = np.triu(wanted, 1)
            found = np.zeros_like(wanted, int)
            for pairs in covertree._descend(a, other, same, threshold):
                np.add.at(found, tuple(pairs.T), 1)
            assert ((found == wanted) | (np.abs(cosines - threshold) < 1e-14)).all()


def test_forest_joins_what_pairs_join():
    rnd = np.random.default_rng(8)
    for pairs in (rnd.integers(0, 300, (250, 2)), np.column_stack([np.arange(299), np.arange(1, 300)]), np.array([[k, 0] for k in range(300)])):
        root, plain = np.arange(300), list(range(300))
        kept = np.concatenate([covertree._forest(part, root) for part in np.array_split(pairs, 3)])
        for i, j in pairs.tolist():
            plain = [plain[i] if p == plain[j] else p for p in plain]
        assert {(root[i] == root[j]) for i, j in pairs} == {True}
        assert len(set(root.tolist())) == len(set(plain)) == 300 - len(kept)


def test_single_precision_vectors_and_negative_zeros(spark, monkeypatch):
    monkeypatch.setattr(covertree, "LEAF", 20)
    x = vectors(2, 120, 0.1)
    rows = [(k, [float(v) for v in x[k]], 0) for k in range(120)]
    rows += [(200, [0.0, 1.0], 0), (201, [-0.0, 1.0], 0), (202, [0.0, 2.0], 0), (203, [-0.0, 0.0], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in covertree.near_duplicates(frame).collect()}
    units = x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    links = (units @ units.T >= 0.98).sum(axis=1) - 1
    assert [found[k][0] for k in range(120)] == links.tolist() and links.sum() > 200
    assert found[200] == found[201] == found[202] == (2, 200) and found[203] == (0, 203)
    assert len(found) == len(rows)


PAGES = [
    (1, "https://A.Example.ORG/es/x?q#f", '<a href="http://bad.net/">b</a>'),
    (2, "http://example.org/en/17", None),
    (3, "http://www.example.org", ""),
    (4, "http://notexample.org/es/", "x"),
    (5, "http://m.x.com/de/1#top", '<A HREF = \'HTTP://Friend.net/a\'>'),
    (6, "http://m.x.com/en/1", ""),
    (7, "http://y.com/fr/1", '<a href="https://good.net?x">'),
    (8, None, None),
    (9, "no scheme", ""),
    (10, "http://bad.net/a", '<a href="http://m.x.com/de/">'),
    (11, "http://good.net/", ""),
    (11, "http://good.net/", ""),
    (12, "x://h?a://b/c", ""),
    (None, "http://com/de/", ""),
]


def test_pages_by_rule_and_by_links(spark):
    frame = spark.createDataFrame([(*p, "x", "y") for p in PAGES], "page_id long, url string, html string, host string, verdict string")
    found = collections.defaultdict(list)
    for r in linkgraph.judge_pages(frame, RULES).collect():
        found[r["page_id"]].append(tuple(r)[1:5])
    rule = {i: v[0][2:4] for i, v in found.items()}
    assert rule[1] == ("example.org/es/", "block") and rule[2] == ("example.org/en/1", "block")
    assert rule[3] == (None, "allow") and rule[4] == ("org/", "allow") and rule[5] == ("com/de/", "block")
    assert rule[7] == ("com/fr/", "allow") and rule[None] == ("com/de/", "block")
    assert found[1][0][:2] == ("a.example.org", "/es/x") and found[8] == found[9] == [("", "", None, "allow")]
    assert found[12][0][:2] == ("h", "") and len(found[11]) == 2
    # bad.net links to a host with a blocked page; distrust goes against the link.
    scores = {r["page_id"]: r for r in linkgraph.judge_pages(frame, RULES).collect()}
    assert scores[10]["distrust"] > 0 and scores[11]["trust"] > 0 and scores[11]["distrust"] == 0
    assert linkgraph.judge_pages(frame.where("false"), RULES).count() == 0


def test_page_mass_equals_a_plain_walk(spark):
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    links = {(r[0], r[1]): r[2] for r in linkgraph.host_links(frame).collect()}
    assert links == {
        ("a.example.org", "bad.net"): 1, ("m.x.com", "friend.net"): 1, ("y.com", "good.net"): 1, ("bad.net", "m.x.com"): 1,
    }
    found = {r["host"]: r for r in linkgraph.judge_pages(frame, RULES).collect()}
    d = linkgraph.DAMPING
    assert found["good.net"]["trust"] == pytest.approx(d)
    assert found["m.x.com"]["distrust"] == pytest.approx(0.5)
    assert found["bad.net"]["distrust"] == pytest.approx(0.5 * d)
    assert found["a.example.org"]["distrust"] == pytest.approx(1 + 0.5 * d * d)


def test_distrust_spreads_until_it_settles(spark):
    """a and b link to each other and to a blocked host that ten hosts link to: 0.085 / 0.15 each."""
    to_seed = "<a href='http://seed.net/'>"
    pages = [(0, "http://seed.net/", ""), (1, "http://a.net/", to_seed + '<a href="http://b.net/">')]
    pages += [(2, "http://b.net/", to_seed + '<a href="http://a.net/">')]
    pages += [(3 + k, f"http://other{k}.net/", to_seed) for k in range(8)]
    # A chain of hosts more than eight links away from the blocked one.
    pages += [(100 + k, f"http://far{k}.net/", f'<a href="http://{f"far{k - 1}" if k else "other0"}.net/">') for k in range(10)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = {r["page_id"]: r for r in linkgraph.judge_pages(frame, [("seed.net", "", "block")]).collect()}
    assert found[1]["distrust"] == pytest.approx(0.085 / 0.15, abs=1e-5) and found[1]["verdict"] == "block"
    assert found[109]["distrust"] == pytest.approx(0.085 * linkgraph.DAMPING**10) and found[3]["verdict"] == "allow"


def test_links_without_scheme_or_quotes(spark):
    html = """<a href=http://bare.net/x?y=//no.net>x</a> <a href=//c.net>x</a> <a HREF = '//D.net/p?u=http://no.net'>
    <a href="/local//no.net"> <a href=local> <a href="HTTP://e.net/a b"> <a href= //f.net/ >"""
    frame = spark.createDataFrame([(1, "https://s.net/", html), (2, "x", html)], "page_id long, url string, html string")
    found = {tuple(r) for r in linkgraph.host_links(frame).collect()}
    assert found == {("s.net", h, 1) for h in ("bare.net", "c.net", "d.net", "e.net", "f.net")}


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    want = duck.execute(f"SELECT {', '.join(found.columns)} FROM ({SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_gives_a_row_per_document(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_registered(sf_dir):
    names = set(entry_module.queries())
    assert "pipeline" in names and {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 14))


def test_pipeline_stages_keep_columns_and_survive_odd_rows(spark, sf_dir, tmp_path):
    current = make(spark, random_rows(8)).repartition(3)
    counts = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, current, sf_dir)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == current.columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        current = spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(current.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    empty = make(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_pipeline_run_equals_its_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.run(spark, sf_dir).collect()
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert out and {r["doc_id"] for r in out} <= ids and len({r["doc_id"] for r in out}) == len(out)


def test_stored_tables_can_be_dropped(spark):
    name = common.stored(spark.range(10), "id")
    assert spark.table(name).count() == 10
    common.drop_stored(spark)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("stored_")]


def linked_pages(seed, n):
    """Hosts under the rules and others, linked in cycles with every form of link."""
    rnd = np.random.default_rng(seed)
    hosts = [f"{h}.{top}" for h in ("a", "b", "c", "d") for top in ("org", "com", "net", "example.org", "test")]
    forms = ['<a href="http://{}/x">', "<A HREF='//{}'>", "<a href=HTTP://{}/y?z>", "<a href=//{}>", '<a href="/local">', "href = https://{}#f "]
    pages = []
    for k in range(n):
        path = rnd.choice(["/", "/es/1", "/en/12", "/fr/2", "/de/x", ""])
        html = " ".join(rnd.choice(forms).format(rnd.choice(hosts)) for _ in range(rnd.integers(0, 4)))
        pages.append((k, f"http://{rnd.choice(hosts)}{path}", html))
    return pages


@pytest.mark.parametrize("seed", [1, 2])
def test_page_twin_equals_the_operator_on_linked_hosts(spark, tmp_path, seed):
    schema = "page_id long, url string, html string"
    pages = linked_pages(seed, 60) + PAGES
    pages += [(900, "http://seed.com/de/", ""), (901, "http://p.net/", "<a href=//seed.com><a href=//q.net>")]
    pages += [(902, "http://q.net/", "<a href='//seed.com'> <a href='//p.net'>")]
    spark.createDataFrame(pages, schema).write.parquet(str(tmp_path / "pages.parquet"))
    found = QUERIES["op8_url_filters"](spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = duck.execute(f"SELECT page_id, host, path, rule, verdict FROM ({SQL['op8_url_filters']})").fetchall()
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))
    # Links decide some of it: verdicts without a rule fall both ways.
    assert {w[4] for w in want if w[3] is None} == {"allow", "block"}
