"""Conversations, pages and vectors."""

import numpy as np
import pytest

from gradus.llm import chat, links, vectors

TURNS = "conv_id long, turn long, role string, text string, h1 int, n int"


def test_snapshots_collapse(spark):
    talk = [("user", "hi"), ("assistant", "hello"), ("user", None), ("assistant", "")]
    rows = [(c, t, *talk[t]) for c, n in ((1, 1), (2, 2), (3, 4), (4, 4)) for t in range(n)]
    rows += [(5, 0, "user", "hi"), (5, 1, "assistant", "other"), (6, 0, "user", ""), (7, 0, "user", None)]
    rows += [(8, None, "user", "late"), (8, None, "user", "early"), (None, 0, "user", "lost"), (9, 1, "user", "x"), (9, 0, "user", "hi")]
    found = {r.conv_id: r for r in chat.render(spark.createDataFrame([(*r, 0, 0) for r in rows], TURNS)).collect()}
    assert set(found) == {3, 5, 6, 7, 8, 9}
    assert found[3].n_copies == 2 and found[3].n_turns == 4
    assert found[5].text == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nother<|im_end|>\n"
    assert found[9].text.startswith("<|im_start|>user\nhi")
    assert chat.render(spark.createDataFrame([], TURNS)).count() == 0


RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def test_rules(spark):
    urls = {
        "http://A.Example.NET/en/x?q#f": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "https://b.net/x": ("b.net", "/x", "net/", "block"),
        "b.net": ("", "", None, "allow"),
        "x://b.net": ("b.net", "", None, "block"),  # by the method: half of the pages of its host are blocked
        "http://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
        "http://example.com/de/1": ("example.com", "/de/1", "example.com/de/", "block"),
        "http://x.org/fr/a\nb": ("x.org", "/fr/a\nb", "org/fr/", "allow"),
        "a://b.c?d://e/f": ("b.c", "", None, "allow"),
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, None, 1) for i, u in enumerate([*urls, *urls])], "page_id long, url string, html string, trust int")
    rows = sorted(links.judge(pages, RULES).collect())
    assert [(r.host, r.path, r.rule, r.verdict) for r in rows] == [*urls.values(), *urls.values()]
    assert links.judge(pages.limit(0), RULES).count() == 0


def test_spread(spark):
    """Against the fixed point, solved on a dense matrix."""
    rng = np.random.default_rng(0)
    m = rng.integers(0, 3, (8, 8)) * (1 - np.eye(8, dtype=int))
    edges = spark.createDataFrame([(f"h{i}", f"h{j}", int(m[i, j])) for i in range(8) for j in range(8) if m[i, j]], "a string, b string, n long")
    seeds = spark.createDataFrame([("h1", 1.0), ("h4", 0.5)], "host string, seed double")
    found = {r.host: r["rank"] for r in links.spread(edges, seeds, 0.5).collect()}
    step = (m / np.maximum(1, m.sum(axis=1, keepdims=True))).T * 0.5
    seed = np.zeros(8)
    seed[[1, 4]] = 1.0, 0.5
    rank = np.linalg.solve(np.eye(8) - step, seed)
    assert abs(sum(found.values()) - rank.sum()) <= 1e-4 * 1.5
    assert np.allclose([found.get(f"h{i}", 0.0) for i in range(8)], rank, atol=2e-4)
    with pytest.raises(RuntimeError):
        links.spread(edges, seeds, 0.5, rounds=3)


def test_distrust_reaches_hosts_that_link_to_blocked_ones(spark):
    link = lambda *hosts: "".join(f"<A class=x HREF = 'http://{h}/'>x</a>" for h in hosts)
    pages = [
        (1, "http://bad.net/a", link()),
        (2, "http://friend.com/a", link("bad.net", "bad.net")),
        (3, "http://mixed.com/a", link("bad.net", "good.org", "good.org", "good.org")),
        (4, "http://good.org/fr/a", link("fine.com")),
        (5, "http://fine.com/a", link("/local", "//good.org") + "<a href=http://good.org/x?y=z class=q>"),
    ]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = {r.page_id: r for r in links.judge(table, RULES, tolerance=0.01).collect()}
    assert rows == {r.page_id: r for r in links.judge(table, RULES, tolerance=0.01, broadcast_rows=0, salts=3).collect()}
    assert {(r.a, r.b): r.n for r in links.edges(table).collect()}[("fine.com", "good.org")] == 1
    assert rows[1].verdict == "block" and rows[2].verdict == "block" and rows[2].distrust > 0.5
    assert {rows[i].verdict for i in (3, 4, 5)} == {"allow"} and rows[5].trust > 0.5


def plain_links(rows, least=0.93):
    ok = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    n, root = [0] * len(rows), list(range(len(rows)))
    for i, (a, la, x) in enumerate(rows):
        for j, (b, lb, y) in enumerate(rows[:i]):
            if None in (la, lb) or la != lb or not ok(x) or not ok(y) or len(x) != len(y):
                continue
            x64, y64 = np.array(x, float), np.array(y, float)
            if x64 @ y64 / np.sqrt((x64 @ x64) * (y64 @ y64)) >= least:
                n[i] += 1
                n[j] += 1
                p, q = root[i], root[j]
                root = [min(p, q) if r in (p, q) else r for r in root]
    names = {r: min(rows[k][0] for k in range(len(rows)) if root[k] == r) for r in set(root)}
    return [(rows[k][0], n[k], names[root[k]], names[root[k]] == rows[k][0]) for k in range(len(rows))]


@pytest.mark.parametrize("bucket_rows", [2048, 7])
def test_vectors(spark, bucket_rows):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(12):
        centre = rng.normal(size=64)
        for _ in range(25):
            v = (centre + rng.normal(size=64) * rng.choice([0.0, 0.05, 0.12])).astype(np.float32)
            rows.append((len(rows), g % 2, v.tolist()))
    odd = [None, [], [0.0] * 64, [float("nan")] * 64, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63, [1.0, 2.0], [2.0, 4.0]]
    rows += [(1000 + i, 0, v) for i, v in enumerate(odd)] + [(2000, None, rows[0][2]), (2001, None, rows[0][2])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, node string").repartition(5)
    found = sorted(tuple(r) for r in vectors.near_duplicates(table, bucket_rows=bucket_rows).collect())
    assert found == sorted(plain_links(rows))


def test_recall_at_the_limit(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(400):
        a = rng.normal(size=64)
        a /= np.linalg.norm(a)
        b = rng.normal(size=64)
        b -= (a @ b) * a
        rows += [(2 * k, 0, a.tolist()), (2 * k + 1, 0, (0.935 * a + np.sqrt(1 - 0.935**2) * b / np.linalg.norm(b)).tolist())]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    found = vectors.near_duplicates(table)
    assert found.agg({"n_links": "sum"}).first()[0] / 800 > 0.95


def quantiser(x, least=0.93):
    return vectors.Quantiser.fit(vectors.unit(np.array(x)), least)


def test_wider_keys_for_crowded_labels(spark):
    assert [vectors.key_bits(n, 64, 8, 2048) for n in (0, 5000, 130_000, 140_000, 10**8, 10**12)] == [8, 8, 8, 10, 16, 16]
    q = quantiser(np.random.default_rng(2).normal(size=(3000, 64)))
    for width in (0, 10, 16):
        masks = vectors.key_masks(q, width, 8, 0.985)
        assert {m.bit_count() for m in masks} == {width or 8} and q.share(masks) >= 0.985 > q.share(masks[:-1])
    assert 12 <= q.radius() <= 22
    # the same pairs as ever, from keys of 10 bits
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(200, 64))
    rows = [(i, 0, (centres[i % 200] + 0.1 * rng.normal(size=64)).tolist()) for i in range(600)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert vectors.key_bits(600, 64, 8, 4) == 10
    assert sorted(tuple(r) for r in vectors.near_duplicates(table, bucket_rows=4).collect()) == sorted(plain_links(rows))


def pairs_at(rng, cosine, size, n, label, first):
    rows = []
    for k in range(n):
        a, b = rng.normal(size=(2, size))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b = cosine * a + np.sqrt(1 - cosine**2) * b / np.linalg.norm(b)
        rows += [(first + 2 * k, label, a.tolist()), (first + 2 * k + 1, label, b.tolist())]
    return rows


def links_in(x, least=0.93):
    x = vectors.unit(np.array(x))
    return int(((x @ x.T) >= least).sum()) - len(x)


def total(df):
    return df.agg({"n_links": "sum"}).first()[0]


def test_recall_of_narrow_and_wide_keys(spark):
    """Pairs at 0.9305 to 0.95: vectors of 64 numbers, and such of which 4 dimensions hold all."""
    rng = np.random.default_rng(8)
    table = lambda r: spark.createDataFrame(r, "vec_id long, label int, embedding array<double>")
    full = [r for i, c in enumerate(np.linspace(0.9305, 0.95, 4)) for r in pairs_at(rng, c, 64, 700, 0, 2000 * i)]
    axes = np.linalg.qr(rng.normal(size=(64, 4)))[0]
    flat = [(i, 0, (axes @ v).tolist()) for i, v in enumerate(rng.normal(size=(1500, 4)))]
    for rows in (full, flat):
        want = links_in([r[2] for r in rows])
        for bucket_rows in (2048, 60):
            assert total(vectors.near_duplicates(table(rows), bucket_rows=bucket_rows)) / want > 0.97
    some = flat[:300]
    assert total(vectors.near_duplicates(table(some), exact=True, bucket_rows=50)) == links_in([r[2] for r in some])
    # a small label's keys do not depend on its neighbour's size
    nodes = table(full + [(10_000 + i, 1, v) for i, (_, _, v) in enumerate(flat[:100])]).select("label", vectors.F.col("embedding").alias("v"))
    plan = vectors.plan_keys(nodes, {64: quantiser([r[2] for r in full])}, 8, 60, 0.9)
    assert sorted(plan.wide.values()) == [10]


def test_short_vectors(spark):
    assert [quantiser(np.random.default_rng(n).normal(size=(50, n))).radius() for n in (2, 7, 16)] == [2, 7, 16]
    rng = np.random.default_rng(9)
    rows = [r for n in range(2, 17) for r in pairs_at(rng, 0.931, n, 20, n, 100 * n)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    found = sorted(tuple(r) for r in vectors.near_duplicates(table).collect())
    want = sorted(plain_links(rows))
    assert sum(r[1] for r in found) >= 0.98 * sum(r[1] for r in want)
    assert sorted(tuple(r) for r in vectors.near_duplicates(table, exact=True).collect()) == want


def test_no_vectors(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")).count() == 0
