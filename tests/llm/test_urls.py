"""URL rules against plain code, and models that tell two kinds of urls apart."""

import random

import numpy as np
from pyspark.sql import functions as F

from proofline.llm import urls

SCHEMA = "page_id long, url string, html string, id string, score string, host string, by_rule string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host_end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    path_end = next((i for i, c in enumerate(rest) if c in "?#" and i >= host_end), len(rest))
    return rest[:host_end].translate(LOWER), rest[host_end:path_end]


def rule(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def listed():
    rng = random.Random(3)
    hosts = ["example.org", "www.Example.ORG", "badexample.org", "org", "a.com", "com", "x.net", "example.org:80", "ÉX.com", "acom"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12/x", "/en/2", "/fr/1", "/de/a//b", "/FR/1", "/de"]
    ends = ["", "?q=/es/", "#/de/", "?a://b", "/"]
    out = [f"{rng.choice(['http', 'https', ''])}://{h}{p}{e}" for h in hosts for p in paths for e in ends]
    return [*out, None, "", "no scheme example.org/", "://", "http://", "http://a\nb.org/x\ny", "x" * 20_000, "http://a.org/" + "y" * 20_000, "http://?org/", "a://b://c.org/", out[0], out[0]]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, None, "a", None, "b", "c") for i, u in rows], SCHEMA)


def test_rules(spark):
    rows = [(i if i % 50 else None, u) for i, u in enumerate(listed())]
    got = urls.op4(pages(spark, rows)).collect()
    assert len(got) == len(rows)
    key = lambda r: tuple(map(str, r))
    assert sorted(((r["page_id"], r["host"], r["path"], r["rule"]) for r in got), key=key) == sorted(((i, *parts(u), rule(*parts(u))[0]) for i, u in rows), key=key)
    assert all(r["verdict"] == (rule(r["host"], r["path"])[1] or ("allow" if r["score"] >= 0.5 else "block")) for r in got)


def test_models_tell_kinds_apart(spark):
    rng = random.Random(5)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(8))
    good, bad = (lambda: f"/news/{word('aeioulm')}"), (lambda: f"/x/{word('qzxkj')}{rng.randrange(999)}")
    rows = [(i, f"http://a.org{good()}" if i % 2 else f"http://b.com/de/{bad()}") for i in range(600)]
    rows += [(1000 + i, f"http://c.net{good()}" if i % 2 else f"http://c.net{bad()}") for i in range(200)]
    got = {r["page_id"]: r for r in urls.op4(pages(spark, rows)).collect()}
    right = sum((got[1000 + i]["verdict"] == "allow") == bool(i % 2) for i in range(200))
    assert right >= 190 and {got[1000]["rule"]} == {None}


def test_no_urls_or_no_rules(spark):
    assert urls.op4(pages(spark, [])).count() == 0
    rows = [(1, "http://x.net/a"), (2, None)]
    assert {(r["verdict"], r["score"]) for r in urls.op4(pages(spark, rows)).collect()} == {("allow", 0.5)}
    only = urls.op4(pages(spark, [(1, "http://a.org/x"), (2, "http://x.net/a")])).collect()
    assert {r["verdict"] for r in only} == {"allow"}


def test_counts_make_chances(spark):
    """The chances of all characters after a context sum to at most one and a hash's worth."""
    model = urls.UrlModel()
    seen = [b"abcabd", b"abx"]
    model.counts[0] = urls.count_grams(seen)
    grams, at, url = urls._grams([b"ab" + bytes([c]) for c in range(4, 200)])
    assert len(at) == 196 * 4 and (np.bincount(url) == 4).all()
    assert model.counts[0][0].sum() == sum(map(len, seen)) + 2 * len(seen)
    d = model.difference([b"abc", b"zzz", b""])
    assert d[0] > d[1] and np.isfinite(d).all()


def test_longest_rule_wins(spark):
    df = spark.createDataFrame([("a.b.org", "/x/y")], "h string, p string")
    r, v = urls.rule_of(F.col("h"), F.col("p"), [("allow", "org", "/x/y"), ("block", "b.org", "/x"), ("allow", "a.b.org", "/"), ("block", "org", "/")])
    assert df.select(r, v).first()[0] == "a.b.org/"


def test_counts_grow_with_the_input(spark):
    """Every gram has its own count, more than 65,536 of them, and the tables' differences are those of one machine, whether grams are broadcast or joined."""
    import zlib

    rng = random.Random(8)
    slug = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789-") for _ in range(40))
    rows = [(i, f"http://{'a.org/' if i % 2 else 'b.com/de/'}{slug()}", "allow" if i % 2 else "block") for i in range(2500)]
    rows += [(5000 + i, f"http://c.net/{slug()}é", None) for i in range(20)] + [(6000, "", None), (6001, rows[0][1], "block")]
    df = spark.createDataFrame(rows, "row long, url string, by_rule string")
    table = urls.settle(urls.gram_table(df))
    model = urls.UrlModel([urls.count_grams([u.encode() for _, u, v in rows if v == word and zlib.crc32(u.encode()) % 5]) for word in ("allow", "block")])
    assert {r["w"]: r["a"] for r in table.where("a > 0").collect()} == model.counts[0][urls.ORDER].to_dict()
    assert table.where("a > 0 or b > 0").count() > 1 << 16
    totals = tuple(table.selectExpr("sum(a)", "sum(b)").first())
    assert totals == tuple(int(c[0].sum()) for c in model.counts)
    ratios = urls.settle(urls.log_ratios(table, totals))
    wanted = model.difference([u.encode() for _, u, _ in rows])
    for hot in (1, 1000, 1 << 30):
        got = {r["row"]: r["d"] for r in urls.differences(df, ratios, hot).collect()}
        assert len(got) == len(rows) and np.allclose([got[i] for i, _, _ in rows], wanted, atol=1e-8)
