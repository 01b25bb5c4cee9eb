"""Segments, forward fill, range joins, samples, against plain loops."""

import json
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from proofline.functions.canonical import sha256_of
from proofline.operators import profile, propagate, sampling, scans, seal, segments, sets


def runs_of(values, on):
    out, start = [], None
    for i, v in enumerate(values):
        if on(v) and start is None:
            start = i
        if not on(v) and start is not None:
            out.append((start, i, False))
            start = None
    return out + ([(start, len(values), True)] if start is not None else [])


def test_bands_and_separators(spark):
    rng = random.Random(5)
    pages = {p: [rng.choice([0.0, 0.0, 0.5, 1.0]) for _ in range(60)] for p in range(20)} | {20: [1.0] * 10, 21: [0.0] * 10, 22: [0.0]}
    profile = spark.createDataFrame([(p, i, v) for p, vs in pages.items() for i, v in enumerate(vs)], "page int, y int, ink double")
    got = {(r["page"], r["start"], r["end"]) for r in segments.row_bands(profile, share=0.08, shortest=2, longest=4).collect()}
    assert got == {(p, a, b) for p, vs in pages.items() for a, b, open_ in runs_of(vs, lambda v: v > 0.08) if not open_ and 2 <= b - a <= 4}
    got = {(r["page"], r["start"], r["end"]) for r in segments.separators(profile, pos="y", share=0.06, shortest=3).collect()}
    assert got == {(p, a, b) for p, vs in pages.items() for a, b, open_ in runs_of(vs, lambda v: v <= 0.06 * max(vs)) if open_ or b - a >= 3}


def test_column_between_widest_separators(spark):
    ink = [1.0] * 10 + [0.0] * 9 + [1.0] * 3 + [0.0] * 9 + [1.0] * 70 + [0.0] * 12 + [1.0] * 5 + [0.0] * 3
    rows = [("a", i, v) for i, v in enumerate(ink)] + [("blank", i, 0.0) for i in range(50)] + [("full", i, 1.0) for i in range(50)]
    got = {r["page"]: (r["lo"], r["hi"]) for r in segments.locate_column(spark.createDataFrame(rows, "page string, x int, ink double"), left_limit=40, right_limit=90, narrowest=60).collect()}
    # Of two equal separators on the left the leftmost counts.
    assert got == {"a": (19, 101), "blank": (None, None), "full": (None, None)}


def test_forward_fill_and_runs_across_chunks(spark):
    rng = random.Random(3)
    rows = [(g, i, rng.random() < 0.1, i * 10 + g) for g in (0, 1, 2) for i in range(200)] + [(3, i, False, i) for i in range(5)]
    df = spark.createDataFrame(rows, "g int, i int, mark boolean, v int")
    filled = {(r["g"], r["i"]): (r["filled"], r["origin"], r["source"]) for r in propagate.forward_fill(df, "g", "i", F.col("mark"), "v", chunk=16).collect()}
    runs = {(r["g"], r["i"]): r["run"] for r in propagate.run_segments(df, "g", "i", F.col("mark"), chunk=16).collect()}
    assert len(filled) == len(rows)
    last, n = {}, {}
    for g, i, mark, v in rows:
        if mark:
            last[g] = (v, i)
            n[g] = n.get(g, 0) + 1
        wanted = (None, None, None) if g not in last else (last[g][0], "READ_DIRECTLY" if mark else "DERIVED", last[g][1])
        assert filled[g, i] == wanted and runs[g, i] == n.get(g, 0)


def test_range_join(spark):
    rng = random.Random(1)
    places = [(rng.randrange(3), rng.randrange(-50, 500)) for _ in range(300)]
    ranges = [(r, rng.randrange(3), a, a + rng.randrange(-3, 90)) for r, a in enumerate(rng.randrange(-50, 450) for _ in range(30))]
    got = propagate.range_join(spark.createDataFrame(places, "k int, n int"), spark.createDataFrame(ranges, "r int, k int, first int, last int"), "k", "n")
    assert sorted((x["k"], x["n"], x["r"]) for x in got.collect()) == sorted((k, n, r) for k, n in places for r, k2, a, b in ranges if k == k2 and a <= n <= b)


def test_samples(spark):
    rows = spark.createDataFrame([(run, i) for run, n in (("a", 10), ("b", 2), ("c", 1), ("d", 3)) for i in range(n)], "run string, i int")
    got = {(r["run"], r["i"], r["position"]) for r in sampling.first_middle_last(rows, "run", "i").collect()}
    assert got == {("a", 0, "first"), ("a", 4, "middle"), ("a", 9, "last"), ("b", 0, "first"), ("b", 1, "last"), ("c", 0, "first"), ("d", 0, "first"), ("d", 1, "middle"), ("d", 2, "last")}
    assert sorted(r["i"] for r in sampling.every_kth(rows.where("run = 'a'"), "run", "i", 4, 1).collect()) == [1, 5, 9]
    assert sorted(r["i"] for r in sampling.at_fractions(rows.where("run = 'a'"), "run", "i", (0, 50, 55, 100)).collect()) == [0, 5, 9]
    assert [r["i"] for r in sampling.outward(rows.where("run = 'a'"), "i", 4).orderBy("step").collect()] == [4, 3, 5, 2, 6, 1, 7, 0, 8, 9]
    once = sampling.seeded(rows, "run", "i", 2, 7).collect()
    assert len(once) == 7 and sorted(once) == sorted(sampling.seeded(rows.repartition(5), "run", "i", 2, 7).collect())


def test_sets(spark):
    a, b = spark.createDataFrame([("x.jpg",), ("y.tar.gz",), ("x.jpg",)], "name string"), spark.createDataFrame([("x.png",), ("z.png",)], "name string")
    assert {(r["stem"], r["in_a"], r["in_b"]) for r in sets.stem_matches(a, b).collect()} == {("x", True, True), ("y.tar", True, False), ("z", False, True)}
    present = spark.createDataFrame([(2,), (3,), (7,)], "n int")
    assert sorted(tuple(r) for r in sets.missing_ranges(present, "n", 1, 9).collect()) == [(1, 1, 1), (4, 6, 3), (8, 9, 2)]
    assert sorted(r["n"] for r in sets.missing_numbers(present, "n", 1, 4).collect()) == [1, 4] and sets.missing_numbers(present, "n", 3, 2).count() == 0


def test_missing_over_whole_tables(spark):
    """Without bounds the table's own least and greatest number hold, and no task orders all numbers."""
    import random

    rng = random.Random(6)
    values = {rng.randrange(-50_000, 50_000) for _ in range(400)} | set(range(7_000, 7_100)) | {-(10**12), 10**12}
    present = spark.createDataFrame([(v,) for v in values] * 2 + [(None,)], "n long")
    at = sorted(values)
    wanted = [(a + 1, b - 1, b - a - 1) for a, b in zip(at, at[1:]) if b > a + 1]
    for chunk in (4, 64, 4096):
        got = sets.missing_ranges(present, "n", chunk=chunk)
        assert sorted(tuple(r) for r in got.collect()) == wanted
    near = present.where("n between 7000 and 9000")
    assert sorted(r["n"] for r in sets.missing_numbers(near, "n").collect()) == sorted(set(range(7_000, max(v for v in at if v <= 9_000))) - values)
    assert sets.missing_ranges(present.limit(0), "n").count() == sets.missing_numbers(present.limit(0), "n").count() == 0


def test_ranges_are_not_ordered_by_one_task(spark):
    present = spark.range(1, 20_000, 3).withColumnRenamed("id", "n")
    plan = sets.missing_ranges(present, "n", 1, 20_000)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_missing_queries_see_all_parts(spark):
    from proofline.plans import reconciliation

    sf = "/root/testdata/sf0.1"
    parts = [r[0] for r in spark.read.parquet(f"{sf}/part.parquet").where("p_size > 10").select("p_partkey").collect()]
    ends = spark.read.parquet(f"{sf}/part.parquet").selectExpr("min(p_partkey)", "max(p_partkey)").first()
    gone = set(range(ends[0], ends[1] + 1)) - set(parts)
    assert max(gone) > 2000 and {r["number"] for r in reconciliation.QUERIES["missing_numbers"](spark, sf).collect()} == gone
    assert sum(r["n"] for r in reconciliation.QUERIES["missing_ranges"](spark, sf).collect()) == len(gone)


def test_pages_of_every_order(spark):
    from proofline.plans import audits

    sf = "/root/testdata/sf0.01"
    got = {r["date"]: r["pages"] for r in audits.QUERIES["pages_by_date"](spark, sf).collect()}
    orders = spark.read.parquet(f"{sf}/orders.parquet").selectExpr("cast(o_orderdate as date) AS d", "o_orderkey AS k").collect()
    assert {(d, k) for d, pages in got.items() for k in pages} == {tuple(r) for r in orders} and any(r["k"] % 50 for r in orders)


def chain(spark, rows):
    """Links (name, parent's name or a hash, what is wrong) with payloads of their own."""
    own = {name: sha256_of({"n": name}) for name, *_ in rows}
    return spark.createDataFrame([(n, "{" if flaw == "json" else json.dumps({"n": n}, indent=1), "x" if flaw == "hash" else own[n], own.get(p, p)) for n, p, flaw in rows], "name string, payload string, recorded string, parent string"), own


def test_chains_to_their_roots(spark):
    links, own = chain(spark, [
        ("r", None, ""), ("a", "r", ""), ("b", "a", ""), ("c", "b", "hash"), ("d", "c", ""), ("e", "d", ""), ("s", "s", ""), ("t", "s", ""), ("x", "z", ""), ("y", "x", ""), ("z", "y", ""), ("w", "z", ""), ("q", None, ""), ("p", "q", ""),
        ("f", "b2", ""), ("g", "b2", ""), ("h", "g", ""), ("b2", "r2", ""), ("r2", None, ""), ("m", "ff", ""), ("n", "m", ""), ("j", "e", "json"), ("k", "j", ""),
    ])
    pins = spark.createDataFrame([(own["r"],), (own["r2"],)], "root string")
    got = {r["name"]: r["reason"] for r in seal.chain_breaks(links, pins).collect()}
    assert got == {
        "c": seal.CHANGED, "d": seal.FLAWED, "e": seal.FLAWED, "s": seal.SELF, "t": seal.FORK, "x": seal.FORK, "w": seal.FORK, "y": seal.CIRCLE, "z": seal.CIRCLE, "q": seal.ASTRAY, "p": seal.ASTRAY, "f": seal.FORK, "g": seal.FORK, "h": seal.FLAWED,
        "m": seal.UNKNOWN, "n": seal.FLAWED, "j": seal.NO_JSON, "k": seal.UNKNOWN,
    }
    assert {r["name"] for r in seal.chain_breaks(links).collect()} == set(got) - {"q", "p"}
    assert seal.chain_breaks(links.limit(0), pins).count() == 0


def test_equal_links_and_null_names(spark):
    links = spark.createDataFrame([("a", "{}", sha256_of({}), None), (None, "{}", sha256_of({}), None), ("b", "[]", sha256_of([]), sha256_of({})), ("c", None, None, None)], "name string, payload string, recorded string, parent string")
    assert sorted((str(r["name"]), r["reason"]) for r in seal.chain_breaks(links).collect()) == [("None", seal.TWICE), ("a", seal.TWICE), ("b", seal.FLAWED), ("c", seal.NO_JSON)]


def test_a_long_chain_in_few_rounds(spark):
    n = 10_000
    key = lambda c: F.sha2(c.cast("string"), 256)
    nodes = spark.range(n).select(key(F.col("id")).alias("own"), F.when(F.col("id") > 0, key(F.col("id") - 1)).alias("parent"), (F.col("id") == 4000).alias("bad"))
    rounds, settled = [], seal.settle
    seal.settle = lambda df: rounds.append(1) or settled(df)
    try:
        got = seal.ancestries(nodes)
    finally:
        seal.settle = settled
    assert len(rounds) <= 16
    counts = {(r["kind"], r["flawed"]): r["count"] for r in got.groupBy("kind", "flawed").count().collect()}
    assert counts == {("ROOT", False): 4001, ("ROOT", True): n - 4001} and got.select("root").distinct().count() == 1


def test_parents_that_are_no_hashes_and_equal_links_of_several_parents(spark):
    """A parent is met only if it is a hash letter by letter; equal links hang, as one, on the least of their parents as text."""
    links, own = chain(spark, [("r", None, ""), ("a", "r", ""), ("up", "-", ""), ("tail", "-", ""), ("none", "", ""), ("below", "none", "")])
    odd = {"up": own["r"].upper(), "tail": own["r"] + "\n"}
    links = links.withColumn("parent", F.coalesce(*[F.when(F.col("name") == n, p) for n, p in odd.items()], "parent"))
    a = {"n": "twice"}
    of = lambda name, parent: (name, json.dumps(a), sha256_of(a), parent)
    more = lambda *rows: links.unionByName(spark.createDataFrame([of(*r) for r in rows], links.schema)).unionByName(spark.createDataFrame([("under", "[7]", sha256_of([7]), sha256_of(a))], links.schema))
    said = lambda *rows: {r["name"]: r["reason"] for r in seal.chain_breaks(more(*rows)).collect()}
    alone = {"up": seal.UNKNOWN, "tail": seal.UNKNOWN, "none": seal.UNKNOWN, "below": seal.FLAWED}
    both = {"e": seal.TWICE, "f": seal.TWICE}
    assert said(("e", None), ("f", own["a"])) == alone | both | {"under": seal.FLAWED}
    assert said(("e", own["a"]), ("f", "zz")) == alone | both | {"under": seal.FLAWED}
    # All hang on the link below them: a circle; a lesser text that is no hash leaves none.
    assert said(("e", sha256_of([7])), ("f", "zz")) == alone | both | {"under": seal.CIRCLE}
    assert said(("e", sha256_of([7])), ("f", " ")) == alone | both | {"under": seal.FLAWED}
    assert said(("e", sha256_of(a)), ("f", "zz")) == alone | {"e": seal.SELF, "f": seal.SELF, "under": seal.FORK}


def test_what_a_chain_moves_is_small_for_each_link(spark):
    """Shuffled, spilled and written bytes of a link in a chain of a hundred: hashes are met once, and rounds carry numbers."""
    n = 60_000
    body = lambda c: F.format_string('{"n":%d}', c)
    i = F.col("id")
    links = spark.range(n).select(F.concat(F.lit("k"), i.cast("string")).alias("name"), body(i).alias("payload"), F.sha2(body(i), 256).alias("recorded"), F.when(i % 100 != 0, F.sha2(body(i - 1), 256)).alias("parent"))
    pins = spark.range(0, n, 200).select(F.sha2(body(i), 256).alias("root"))
    sc = spark.sparkContext
    store, listed = sc._jsc.sc().statusStore(), lambda: store.stageList(sc._jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())

    def moved() -> dict:
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = listed()
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() + s.diskBytesSpilled() + s.outputBytes() for s in (stages.apply(k) for k in range(stages.size()))}

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = moved()
        assert seal.chain_breaks(links, pins).groupBy("reason").count().collect() == [(seal.ASTRAY, n // 2)]
        bytes_ = sum(v for k, v in moved().items() if k not in before)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert 0 < bytes_ < 800 * n, bytes_ / n


def test_sparse_and_text_orders_are_cut_by_rows(spark):
    """What chunks hold is rows, however far apart their orders are: no more summary rows than chunks, and no chunk much above its share."""
    n, chunk = 100_000, 1000
    df = spark.range(n).select(F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("p"), (F.col("id") % 500).cast("string"))).alias("g"), (F.col("id") * 1_000_003).alias("n"), F.format_string("k%012d", F.col("id") * 77).alias("s"), "id", (F.col("id") % 1700 == 5).alias("m"))
    for order in ("n", "s"):
        cut = scans.chunks(df, "g", order, chunk)
        sizes = cut.rows.groupBy("g", cut.at).count().where("g = 'hot'").agg(F.count(F.lit(1)), F.max("count")).first()
        assert 60 <= sizes[0] <= 130 and sizes[1] <= 5 * chunk and cut.summary(F.count(F.lit(1)).alias("x")).count() <= n / chunk + 20
        filled = propagate.forward_fill(df, "g", order, F.col("m"), "id", chunk=chunk)
        plain = Window.partitionBy("g").orderBy(order)
        wanted = df.withColumns({"want": F.last(F.when(F.col("m"), F.col("id")), ignorenulls=True).over(plain), "i": F.row_number().over(plain) - 1, "back": F.col("id") - F.lag("id").over(plain), "runs": F.sum(F.col("m").cast("int")).over(plain.rowsBetween(Window.unboundedPreceding, 0))}).select("id", "want", "i", "back", "runs")
        assert filled.join(wanted, "id").where("not (filled <=> want)").count() == 0
        assert propagate.run_segments(df, "g", order, F.col("m"), chunk=chunk).join(wanted, "id").where("run <> runs").count() == 0
        r, i, all_ = sampling.ranked(df, "g", order, chunk)
        assert r.join(wanted.withColumnRenamed("i", "want_i"), "id").where(f"{i} <> want_i").count() == 0 and {x[0] for x in r.where("g = 'hot'").select(all_).distinct().collect()} == {n * 9 // 10}
        assert profile.cadence(df, "g", order, "id", chunk).join(wanted, "id").where("not (step <=> back)").count() == 0


def test_ties_and_nulls_across_cuts(spark):
    rng = random.Random(9)
    rows = [(rng.choice([None, 1, 2]), rng.choice([None, *range(40)]), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "g int, n int, id int")
    r, i, all_ = sampling.ranked(df, "g", "n", 50)
    assert all(sorted(x[i] for x in own) == list(range(len(own))) and {x[all_] for x in own} == {len(own)} for own in ([x for x in r.collect() if x["g"] == g] for g in (None, 1, 2)))
    assert [x["n"] for g in (None, 1, 2) for x in sorted((x for x in r.collect() if x["g"] == g), key=lambda x: x[i])] == [n for g in (None, 1, 2) for n in sorted((x[1] for x in rows if x[0] == g), key=lambda n: (n is not None, n or 0))]


def test_a_giant_range_is_a_few_blocks(spark):
    ranges = spark.createDataFrame([(0, 1, 0, 10**9), (1, 1, 5, 5), (2, 1, -(10**12), 10**12), (3, 1, 5, 5), (4, 1, 9, 8), (5, 1, None, 4), (6, None, 0, 9), (7, 2, 0, 9)], "r int, k int, first long, last long")
    blocks = ranges.where("r = 0").select(F.explode(propagate.aligned_blocks(F.col("first"), F.col("last"), propagate.LEVELS)).alias("b")).select("b.*").collect()
    assert len(blocks) <= 60
    spans = sorted((b["number"] << b["level"], (b["number"] + 1 << b["level"]) - 1) for b in blocks)
    assert spans[0][0] == 0 and spans[-1][1] == 10**9 and all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:]))
    places = spark.createDataFrame([(1, 5), (1, 10**9), (1, 10**9 + 1), (1, -7), (1, 5), (None, 5), (1, None), (3, 5), (2, 9)], "k int, n long")
    got = propagate.range_join(places, ranges, "k", "n")
    at = {0: (0, 10**9), 1: (5, 5), 2: (-(10**12), 10**12), 3: (5, 5)}
    wanted = [(1, n, r) for n in (5, 10**9, 10**9 + 1, -7, 5) for r, (a, b) in at.items() if a <= n <= b] + [(2, 9, 7)]
    assert sorted((x["k"], x["n"], x["r"]) for x in got.collect()) == sorted(wanted)
    assert "BroadcastNestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert propagate.range_join(places, ranges.limit(0), "k", "n").count() == 0


def test_parts_of_numbers_between_places(spark):
    places = spark.createDataFrame([("a", 1.5), ("a", 2.0), ("a", -0.5)], "k string, x double")
    ranges = spark.createDataFrame([("a", 1, 1.25, 1.75), ("a", 2, -1.0, 2.0)], "k string, r int, first double, last double")
    assert sorted((r["x"], r["r"]) for r in propagate.range_join(places, ranges, "k", "x").collect()) == [(-0.5, 2), (1.5, 1), (1.5, 2), (2.0, 2)]


def test_absent_places_end_a_run(spark):
    df = spark.createDataFrame([("p", x, v) for x, v in ((0, 1.0), (1, 0.0), (5, 0.0), (6, 1.0))] + [("p", None, 0.0)], "page string, _on int, _top double")
    assert [tuple(r) for r in segments.separators(df, pos="_on", value="_top", shortest=1).orderBy("start").collect()] == [("p", 1, 2), ("p", 5, 6)]
    assert segments.row_bands(df, pos="_on", value="_top", shortest=1).collect() == [("p", 0, 1)]
