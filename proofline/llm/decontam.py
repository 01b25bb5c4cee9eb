"""Benchmark decontamination by winnowed fingerprints, with DataFrame functions only.

Winnowing slides a window over a text's k-gram hashes, keeps the smallest of each (the leftmost of equal ones), and each place that is kept once. With k-grams of 4
words and 7 of them to a window, each span of 10 words keeps at least one, and equal spans keep the same: a passage that a document and a benchmark item share is
always found. Fingerprints that the benchmark has are told by a bitmap whose size is bounded; the document's places that pass join the
benchmark's on the fingerprint alone. Each hit is extended word by word to the left and right, as far as a window that kept the place can reach, and counts if a whole
window matches; a longer passage is the union of its hits.

A fingerprint that stands in many different surroundings (items from one template) would bring each of them to every document that has it. Beyond CONTEXTS of them it
is split: its windows are joined whole, so that each meets only its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, words

#: Bytes of the benchmark's places, with their surroundings, that are broadcast; beyond it Spark joins by shuffling.
BROADCAST_BYTES = 8 << 20
#: A fingerprint's different surroundings that are compared one by one.
CONTEXTS = 64
#: Bits of the bitmap: 32 for each of the benchmark's fingerprints, within these bounds.
LEAST_BITS, MOST_BITS = 1 << 14, 1 << 22


def _both(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def _pairwise(df: DataFrame, name: str, a: str, b: str, shift: int, f) -> DataFrame:
    """Column name: f(a[i], b[i + shift]). Past the end f sees null; those places belong to no whole window and are never read."""
    return df.withColumn(name, F.zip_with(F.col(a), F.slice(F.col(b), shift + 1, F.size(b)), f))


def _fingerprints(df: DataFrame, length: int, k: int) -> DataFrame:
    """From the words _w: column _m{length}, at each start the smallest hash of the k-grams in the window of so many words. Doubling makes it log(length) passes."""
    k = min(k, length)
    have = {int(c[2:]) for c in df.columns if c.startswith("_g")}
    if k not in have and k > 1 and 2 not in have:
        df = _pairwise(df, "_g2", "_w", "_w", 1, _both)
        have.add(2)
    if k == 1 and 1 not in have:
        df = df.withColumn("_g1", F.transform("_w", lambda w: F.xxhash64(w)))
    elif k == 3 and 3 not in have:
        df = _pairwise(df, "_g3", "_g2", "_w", 2, _both)
    else:
        size = 2
        while size < k:
            grow = min(size, k - size)
            if size + grow not in have:
                df = _pairwise(df, f"_g{size + grow}", f"_g{size}", f"_g{size}", grow, _both)
                have.add(size + grow)
            size += grow
    width, size, at = length - k + 1, 1, f"_g{k}"
    while size < width:
        grow = min(size, width - size)
        name = f"_m{length}" if size + grow == width else f"_m{length}_{size + grow}"
        df = _pairwise(df, name, at, at, grow, lambda a, b: F.least(a, b))
        at, size = name, size + grow
    return df if width > 1 else df.withColumn(f"_m{length}", F.col(at))


def _places(length: int, k: int, wanted: Column | None = None) -> Column:
    """The places of _w that winnowing keeps in windows of so many words, as an array of (n, fp, at, off, near): near are the words around, those of all windows that hold
    the k-gram at the place, which is word off of them. wanted: a test of fingerprints."""
    k = min(k, length)
    m, g, n, width = F.col(f"_m{length}"), F.col(f"_g{k}"), F.size("_w"), length - k + 1
    starts = F.when(n >= length, F.sequence(F.lit(0), n - length)).otherwise(F.array().cast("array<int>"))
    if wanted is not None:
        starts = F.filter(starts, lambda i: wanted(F.get(m, i)))
    at = F.array_distinct(F.transform(starts, lambda i: i + F.array_position(F.slice(g, i + 1, width), F.get(m, i)).cast("int") - 1))
    return F.transform(
        at,
        lambda i: F.struct(
            F.lit(length).alias("n"), F.get(g, i).alias("fp"), i.alias("at"), F.least(i, F.lit(length - k)).alias("off"), F.slice("_w", F.greatest(i - (length - k), F.lit(0)) + 1, F.least(i, F.lit(length - k)) + length).alias("near")
        ),
    )


def benchmark_places(benchmark: DataFrame, window: int = 10, k: int = 4, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, list[int]]:
    """((item, n, fp, off, near), lengths): the places kept in each item, whose id is a string, and the lengths of windows, the usual one and those of shorter items.

    An item of fewer words than a window is one window of its own; one without words has none, and a null id counts as no item.
    """
    items = settle(benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("_w")).where(F.size("_w") > 0))
    lengths = sorted(r[0] for r in items.select(F.least(F.size("_w"), F.lit(window)).alias("n")).distinct().collect())
    parts = []
    for n in lengths or [window]:
        of = items.where(F.size("_w") >= n if n == window else F.size("_w") == n)
        parts.append(_fingerprints(of, n, k).select("item", F.explode(_places(n, k)).alias("x")).select("item", "x.n", "x.fp", "x.off", "x.near"))
    return settle(reduce(DataFrame.unionByName, parts).distinct()), lengths


def _windows_around(near: Column, off: Column, n: Column, k: int) -> Column:
    """The windows of n words in near that hold the k-gram at word off, as an array of (back, words): back is how many words before the place it begins."""
    least, most = F.greatest(off - (n - F.least(n, F.lit(k))), F.lit(0)), F.least(off, F.size(near) - n)
    starts = F.when(least <= most, F.sequence(least, F.greatest(most, least))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct((off - s).alias("back"), F.array_join(F.slice(near, s + 1, n), " ").alias("words")))


def _alike(a: tuple[Column, Column], b: tuple[Column, Column], n: Column, k: int) -> tuple[Column, Column]:
    """How many words on end are equal before a place, and from it on, in two (near, off)."""
    same = lambda r: F.get(a[0], a[1] + r) == F.get(b[0], b[1] + r)
    reach = n - F.least(n, F.lit(k))
    before = F.aggregate(F.sequence(F.lit(0), reach), F.lit(0), lambda got, r: F.when((r > 0) & (got == r - 1) & same(-r), r).otherwise(got))
    behind = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda got, r: F.when((got == r) & same(r), r + 1).otherwise(got))
    return before, behind


def _bitmap(fps: DataFrame, bits: int) -> DataFrame:
    """One row with an array of bits / 64 longs in which the low bits of each fingerprint are marked."""
    marks = fps.select(F.col("fp").bitwiseAND(bits - 1).alias("at")).distinct().select(F.shiftright("at", 6).alias("id"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("mark"))
    full = fps.sparkSession.range(0, bits // 64, 1, 1).withColumn("mark", F.lit(0).cast("long"))
    return full.unionByName(marks).groupBy("id").agg(F.bit_or("mark").alias("mark")).agg(F.array_sort(F.collect_list(F.struct("id", "mark"))).alias("x")).select(F.col("x.mark").alias("bits"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """({id_col}, text_hash, n_words, n_hit, n_items, items_sha256, items (array of string), spans (array of (start, end) in words), contaminated): a row for each row of docs.

    A word is hit if it stands in a window that a benchmark item has; spans are the extended hits, maximal and disjoint. Repeated rows and null ids stay, and
    each row is judged by its own text. A null text has no words. Other columns are neither read nor returned. An empty benchmark hits nothing.
    """
    places, lengths = benchmark_places(benchmark, window, k)
    bits = LEAST_BITS
    n_places, n_bytes = places.agg(F.count(F.lit(1)), F.sum(32 + F.octet_length(F.array_join("near", " ")))).first()
    while bits < min(MOST_BITS, 32 * n_places):
        bits *= 2
    marked = _bitmap(places.select("fp"), bits).first()[0]

    # Text by text: its length and the places that may be the benchmark's. Written, as it is read twice and costs most.
    text = F.col(text_col)
    found = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_h"), words(text).alias("_w"))
    for n in lengths:
        found = _fingerprints(found, n, k)
    found = found.withColumn("_bits", F.from_json(F.lit("[" + ",".join(map(str, marked)) + "]"), "array<bigint>"))
    test = lambda fp: F.expr("1L").bitwiseAND(F.call_function("shiftright", F.get("_bits", F.call_function("shiftrightunsigned", fp.bitwiseAND(bits - 1), F.lit(6)).cast("int")), fp.bitwiseAND(63).cast("int"))) == 1
    kept = F.concat(*[_places(n, k, test) for n in lengths]) if lengths else F.array().cast("array<struct<n:int,fp:bigint,at:int,off:int,near:array<string>>>")
    each = settle(found.select(F.monotonically_increasing_id().alias("row"), "_id", "_h", F.size("_w").cast("long").alias("n_words"), kept.alias("kept")))
    at_places = each.where(F.size("kept") > 0).select("row", F.explode("kept").alias("x")).select("row", "x.n", "x.fp", "x.at", "x.off", "x.near")

    # Surroundings by fingerprint; of a crowded fingerprint one row that has none.
    near_id = F.sha2(F.concat_ws(" ", "n", "off", "near"), 256)
    around = places.select("n", "fp", "off", "near").distinct()
    crowded = around.groupBy("n", "fp").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > CONTEXTS).select("n", "fp")
    light = around.join(crowded, ["n", "fp"], "left_anti").select("n", "fp", F.col("off").alias("off_"), F.col("near").alias("near_"), near_id.alias("id"))
    index = light.unionByName(crowded, allowMissingColumns=True)
    met = at_places.join(F.broadcast(index) if (n_bytes or 0) <= BROADCAST_BYTES else index, ["n", "fp"])
    before, behind = _alike((F.col("near"), F.col("off")), (F.col("near_"), F.col("off_")), F.col("n"), k)
    extended = met.where("near_ is not null").withColumns({"before": before, "behind": behind}).where((F.col("behind") >= F.least("n", F.lit(k))) & (F.col("before") + F.col("behind") >= F.col("n")))
    hits = extended.select("row", (F.col("at") - F.col("before")).alias("start"), (F.col("at") + F.col("behind")).alias("end"), "id")
    whole_id = F.sha2(F.concat_ws(" ", F.lit("whole"), "words"), 256)
    whole = lambda df, *own: df.select(*own, "n", F.explode(_windows_around(F.col("near"), F.col("off"), F.col("n"), k)).alias("x")).select(*own, "n", "x.back", "x.words")
    of_crowded = whole(places.join(crowded, ["n", "fp"], "left_semi"), "item").select("item", "n", "words", whole_id.alias("id")).distinct()
    there = whole(met.where("near_ is null"), "row", "at").join(of_crowded.select("n", "words", "id").distinct(), ["n", "words"])
    hits = hits.unionByName(there.select("row", (F.col("at") - F.col("back")).alias("start"), (F.col("at") - F.col("back") + F.col("n")).alias("end"), "id"))

    # Which items: once for each set of surroundings, however many texts have it.
    by_row = settle(hits.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("at"), F.array_sort(F.collect_set("id")).alias("ids")).withColumn("set", F.sha2(F.array_join("ids", ""), 256)))
    sets = by_row.groupBy("set").agg(F.first("ids").alias("ids")).select("set", F.explode("ids").alias("id"))
    owners = places.join(crowded, ["n", "fp"], "left_anti").select(near_id.alias("id"), "item").unionByName(of_crowded.select("id", "item"))
    items = sets.join(owners, "id").groupBy("set").agg(F.array_sort(F.collect_set("item")).alias("items"))
    # Their number and checksum are made here, so that a reader of these alone moves no list of items to any text.
    items = items.select("set", "items", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    known = by_row.join(items, "set").select(F.col("row").alias("_row"), "at", "items", "n_items", "items_sha256")
    none = F.array().cast("array<struct<start:int,end:int>>")
    whole = each.join(known, F.col("row") == F.col("_row"), "left").select("_id", "_h", "n_words", F.coalesce("at", none).alias("at"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"))
    spans = F.aggregate(
        F.array_sort("at"),
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda out, x: F.when((F.size(out) > 0) & (F.element_at(out, -1)["end"] >= x["start"]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["start"].alias("start"), F.greatest(F.element_at(out, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(out, F.array(x))),
    )
    whole = whole.withColumn("spans", F.when(F.size("at") > 0, spans).otherwise(none))
    # Counted by one pass that carries a sum and an end, so that a reader of the counts alone needn't build the spans.
    count = F.aggregate(
        F.array_sort("at"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["end"], x["start"]))).alias("n"), F.greatest(a["end"], x["end"]).alias("end")),
    )
    n_hit = F.coalesce(count["n"], F.lit(0).cast("long"))
    return whole.withColumn("n_hit", n_hit).select(
        F.col("_id").alias(id_col), F.col("_h").alias("text_hash"), "n_words", "n_hit", "n_items", "items_sha256", "items", "spans", (F.col("n_hit") > 0).alias("contaminated")
    )


def op1(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of decontaminate() that op1_decontaminate returns."""
    return decontaminate(docs, benchmark).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS_SQL = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_SQL} AS w FROM benchmark WHERE item_id IS NOT NULL),
item_windows AS (
    SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win
    FROM (SELECT item, w, least(len(w), 10) AS n, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0) AS x
),
doc_windows AS (
    SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
    FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM item_windows) AS l WHERE len(w) >= n) AS x
),
hits AS (SELECT r, i, n, item FROM doc_windows JOIN item_windows USING (n, win)),
hit_words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM (SELECT DISTINCT r, i, n FROM hits) AS x) AS y GROUP BY r),
hit_items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""
