"""Queries that profile, audit and check integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import integrity, profile, seal
from ..schemas import MISSINGNESS
from ..sources.records import checksum_manifest
from .registry import Registry, shared_dir, table

query = Registry()


@query(
    """
    WITH n AS (SELECT user_id, event_type, count(*) AS votes FROM events WHERE value > 20 GROUP BY ALL)
    SELECT u.user_id, t.event_type, coalesce(t.votes, 0) AS votes FROM (SELECT DISTINCT user_id FROM events) AS u
    LEFT JOIN (SELECT user_id, event_type, votes FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, event_type) AS i FROM n) AS x WHERE i = 1) AS t ON u.user_id = t.user_id"""
)
def page_value_mode(spark, sf_dir):
    return profile.page_value(table(spark, sf_dir, "events"), "user_id", "event_type", F.col("value") > 20)


@query(
    """
    SELECT o_custkey, count(DISTINCT o_orderpriority) FILTER (o_orderkey % 4 <> 0) AS n_values, count(*) FILTER (o_orderkey % 4 = 0) AS n_illegible,
        CASE WHEN count(DISTINCT o_orderpriority) FILTER (o_orderkey % 4 <> 0) = 1 AND count(*) FILTER (o_orderkey % 4 = 0) = 0 THEN 'CONSTANCY_SAMPLE_PASS'
            WHEN count(DISTINCT o_orderpriority) FILTER (o_orderkey % 4 <> 0) > 1 AND count(*) FILTER (o_orderkey % 4 = 0) > 0 THEN 'CONSTANCY_SAMPLE_FAIL_AND_UNREADABLE'
            WHEN count(DISTINCT o_orderpriority) FILTER (o_orderkey % 4 <> 0) > 1 THEN 'CONSTANCY_SAMPLE_FAIL' ELSE 'CONSTANCY_SAMPLE_UNREADABLE_OR_AMBIGUOUS' END AS class
    FROM orders GROUP BY o_custkey"""
)
def constancy_class(spark, sf_dir):
    return profile.constancy_class(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", F.col("o_orderkey") % 4 != 0)


@query("SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS values FROM orders GROUP BY o_custkey")
def distinct_values(spark, sf_dir):
    return profile.distinct_values(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


@query(
    """
    SELECT o_orderpriority, i // 1000 AS piece, ceil(n / 1000.0)::BIGINT AS pieces, list(o_orderkey ORDER BY o_orderkey) AS values
    FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM (SELECT DISTINCT o_orderpriority, o_orderkey FROM orders)) GROUP BY 1, 2, 3"""
)
def value_pieces(spark, sf_dir):
    """The orders of each priority in pieces of a thousand."""
    return profile.value_pieces(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey", 1000, chunk=20_000)


@query("SELECT CAST(o_orderdate AS DATE) AS date, list_sort(list(DISTINCT o_orderkey)) AS pages FROM orders GROUP BY 1")
def pages_by_date(spark, sf_dir):
    return profile.pages_by_date(table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date"), "o_orderkey"), "date", "o_orderkey")


@query(
    """
    WITH n AS (SELECT user_id, event_type, count(*) AS votes FROM events WHERE value > 20 GROUP BY ALL), v AS (SELECT user_id, arg_max(event_type, ROW(votes, -ascii(event_type))) AS event_type FROM n GROUP BY user_id)
    SELECT t.user_id, v.event_type, t.truth, CASE WHEN v.event_type IS NULL THEN 'NO CONSENSUS' WHEN v.event_type = t.truth THEN 'MATCH' ELSE 'DIFFERENT' END AS outcome
    FROM (SELECT user_id, max(event_type) AS truth FROM events GROUP BY user_id) AS t LEFT JOIN v ON t.user_id = v.user_id"""
)
def page_truth(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    values = profile.page_value(events, "user_id", "event_type", F.col("value") > 20).where("event_type is not null")
    return profile.page_truth(values, events.groupBy("user_id").agg(F.max("event_type").alias("truth")), "user_id", "event_type")


@query(
    """
    SELECT *, round(done * 3600.0 / nullif(elapsed_s, 0), 3) AS per_hour, round(elapsed_s * greatest(1000000 - done, 0) / nullif(done, 0), 3) AS remaining_s
    FROM (SELECT count(*) FILTER (value > 5) AS done, count(*) FILTER (value <= 5) AS failed, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS elapsed_s FROM events) AS x"""
)
def run_throughput(spark, sf_dir):
    return profile.throughput(table(spark, sf_dir, "events").select("ts", (F.col("value") > 5).alias("ok")), "ts", "ok", 1_000_000)


LOCATED_SQL = "SELECT d.doc_id, d.source, d.n_chars, m.median, d.n_chars < m.median * 0.8 AS is_candidate FROM documents AS d JOIN (SELECT source, median(n_chars) AS median FROM documents GROUP BY source) AS m ON d.source = m.source"


@query(LOCATED_SQL)
def size_locator(spark, sf_dir):
    return profile.size_locator(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "source", "n_chars")


@query(
    f"""
    SELECT tp AS true_positive, fp AS false_positive, fn AS false_negative, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall
    FROM (SELECT count(*) FILTER (is_candidate AND quality = 0) AS tp, count(*) FILTER (is_candidate AND quality <> 0) AS fp, count(*) FILTER (NOT is_candidate AND quality = 0) AS fn FROM ({LOCATED_SQL}) AS l JOIN labels USING (doc_id)) AS x"""
)
def locator_precision(spark, sf_dir):
    found = size_locator(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    return profile.locator_quality(found, F.col("is_candidate"), F.col("quality") == 0)


@query("SELECT o_custkey, coalesce(bool_or(o_orderdate < TIMESTAMP '1995-01-01') AND bool_or(o_orderdate > TIMESTAMP '1996-12-31'), FALSE) AS bracketed FROM orders GROUP BY o_custkey")
def bracketing(spark, sf_dir):
    return profile.bracketing(table(spark, sf_dir, "orders").select(F.col("o_custkey"), "o_orderdate"), "o_custkey", "o_orderdate", "1995-01-01", "1996-12-31")


@query(
    """
    SELECT class, count(o.c) AS n FROM (VALUES ('PRESENT_LEGIBLE'), ('PRESENT_ILLEGIBLE'), ('ABSENT_FROM_ARCHIVE'), ('NOT_DIGITISED'), ('UNDETERMINED')) AS d(class)
    LEFT JOIN (SELECT CASE o_orderstatus WHEN 'F' THEN 'PRESENT_LEGIBLE' WHEN 'O' THEN 'PRESENT_ILLEGIBLE' ELSE 'UNDETERMINED' END AS c FROM orders) AS o ON o.c = d.class GROUP BY class"""
)
def coverage_classes(spark, sf_dir):
    status = F.col("o_orderstatus")
    rows = table(spark, sf_dir, "orders").select(F.when(status == "F", "PRESENT_LEGIBLE").when(status == "O", "PRESENT_ILLEGIBLE").otherwise("UNDETERMINED").alias("c"))
    return profile.coverage_by_class(rows, "c", MISSINGNESS)


MANIFEST_SQL = "SELECT page_id::VARCHAR AS name, CASE WHEN page_id % 5 = 0 THEN sha1(url) ELSE sha1(html) END AS sha1 FROM pages WHERE page_id % 7 <> 0"


@query(
    f"""
    SELECT p.page_id, m.sha1 AS published_sha1, sha1(html) AS local_sha1, sha256(html) AS local_sha256, CASE WHEN m.sha1 = sha1(html) THEN 'CONSISTENT_WITH_SOURCE_PUBLISHED_CHECKSUM' ELSE 'MISMATCH_OR_ABSENT' END AS byte_integrity, 'UNESTABLISHED' AS source_authenticity,
        CASE WHEN octet_length(encode(html)) < 1500 THEN 'SOURCE_INPUT_INVALID' WHEN m.sha1 IS DISTINCT FROM sha1(html) THEN 'INTEGRITY' END AS failure, octet_length(encode(html)) >= 1500 AND m.sha1 IS NOT DISTINCT FROM sha1(html) AS ok
    FROM pages AS p LEFT JOIN ({MANIFEST_SQL}) AS m ON p.page_id::VARCHAR = m.name"""
)
def integrity_manifest(spark, sf_dir):
    """The manifest is written as text and reread; an older file has another sum for every name, and the later line counts."""
    pages = table(spark, sf_dir, "pages")
    name = F.col("page_id").cast("string")
    sums = pages.where("page_id % 7 <> 0").select(name.alias("name"), F.sha1(F.when(F.col("page_id") % 5 == 0, F.col("url")).otherwise(F.col("html"))).alias("sha1"))
    out = shared_dir(spark, "manifest")
    for folder, sha1 in (("0-old", F.lit("aa")), ("1-new", F.col("sha1"))):
        sums.select(F.concat_ws("  ", sha1, "name").alias("value")).write.text(f"{out}/{folder}")
    manifest = checksum_manifest(spark, [f"{out}/0-old", f"{out}/1-new"])
    verified = integrity.verified_pages(pages.select("page_id", name.alias("name"), F.col("html").alias("content")), manifest, least_bytes=1500)
    return verified.select("page_id", "published_sha1", "local_sha1", "local_sha256", "byte_integrity", "source_authenticity", "failure", "ok")


@query("SELECT n_name AS name, sha256(n_name || '!') AS expected, sha256(n_name) AS found FROM nation WHERE n_nationkey % 5 = 0")
def tool_drift(spark, sf_dir):
    nations = table(spark, sf_dir, "nation")
    k, name = F.col("n_nationkey"), F.col("n_name")
    expected = nations.select(name.alias("name"), F.when(k % 5 == 0, F.sha2(F.concat(name, F.lit("!")), 256)).when(k % 5 == 1, integrity.PENDING).otherwise(F.sha2(name, 256)).alias("sha256"))
    return integrity.drifted(expected, nations.select(name.alias("name"), F.sha2(name, 256).alias("sha256")))


# A link for each order, bound to the order before it but for every hundredth, a root; what doesn't hold is chosen by key: payloads, records, parents that are not there, links bound to themselves, forks, circles, and roots that aren't pinned (those of odd hundreds).
LINKS_SQL = """
    SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9700 <> 11 THEN sha256('{"order":' || o_orderkey || '}') END AS own, sha256('{"order":' || CASE WHEN o_orderkey % 8900 = 13 THEN -1 ELSE o_orderkey END || '}') AS recorded,
        CASE WHEN o_orderkey % 100 <> 0 THEN sha256('{"order":' || CASE WHEN o_orderkey % 8300 = 17 THEN -2 WHEN o_orderkey % 3000 = 919 THEN o_orderkey WHEN o_orderkey % 3000 = 723 THEN o_orderkey - 2 WHEN o_orderkey % 3000 = 1525 THEN o_orderkey + 40 ELSE o_orderkey - 1 END || '}') END AS parent FROM orders"""


@query(
    f"""
    WITH RECURSIVE l AS ({LINKS_SQL}),
    forks AS (SELECT parent FROM l WHERE parent IS NOT NULL GROUP BY parent HAVING count(*) > 1),
    own_flaw AS (
        SELECT *, CASE WHEN own IS NULL THEN 'payload is no JSON' WHEN own <> recorded THEN 're-derived hash differs from the recorded one' WHEN own = parent THEN 'bound to itself' WHEN parent NOT IN (SELECT own FROM l WHERE own IS NOT NULL) THEN 'parent is not in the chain'
            WHEN parent IN (SELECT parent FROM forks) THEN 'another link is bound to the same parent' END AS flaw
        FROM l),
    reached(own, flawed, root) AS (
        SELECT own, flaw IS NOT NULL, k FROM own_flaw WHERE own IS NOT NULL AND (parent IS NULL OR own = parent OR flaw = 'parent is not in the chain' OR flaw = 're-derived hash differs from the recorded one' AND parent NOT IN (SELECT own FROM l WHERE own IS NOT NULL))
        UNION ALL
        SELECT f.own, r.flawed OR f.flaw IS NOT NULL, r.root FROM own_flaw f JOIN reached r ON f.parent = r.own WHERE f.own <> f.parent),
    said AS (
        SELECT f.k, CASE WHEN flaw IS NOT NULL THEN flaw WHEN r.own IS NULL THEN 'its ancestors run in a circle' WHEN r.flawed THEN 'an ancestor is broken' WHEN (r.root // 100) % 2 = 1 THEN 'its root is not the pinned one' END AS reason
        FROM own_flaw f LEFT JOIN reached r ON f.own = r.own)
    SELECT k::VARCHAR AS name, reason FROM said WHERE reason IS NOT NULL"""
)
def hash_chain_of_orders(spark, sf_dir):
    """Followed to its root from each link; the roots of even hundreds are pinned."""
    k = F.col("o_orderkey")
    link = lambda n, form: F.format_string(form, n.cast("long"))
    hashed = lambda n: F.sha2(link(n, '{"order":%d}'), 256)
    bound = F.when(k % 8300 == 17, -2).when(k % 3000 == 919, k).when(k % 3000 == 723, k - 2).when(k % 3000 == 1525, k + 40).otherwise(k - 1)
    orders = table(spark, sf_dir, "orders")
    links = orders.select(
        k.cast("string").alias("name"),
        F.when(k % 9700 == 11, "{").otherwise(link(k, '{ "order" : %d }')).alias("payload"),
        hashed(F.when(k % 8900 == 13, -1).otherwise(k)).alias("recorded"),
        F.when(k % 100 != 0, hashed(bound)).alias("parent"),
    )
    roots = orders.where("o_orderkey % 200 = 0").select(hashed(k).alias("root"))
    return seal.chain_breaks(links, roots)


BOUNDS = "SELECT o_orderkey, o_orderkey % 4 <> 0 AS b1, o_orderkey % 5 = 0 AS b3, o_orderkey % 7 <> 0 AS told FROM orders"


@query(
    f"""
    SELECT o_orderkey::VARCHAR AS name, list_sort(list_filter([CASE WHEN NOT b1 THEN 'missing B1' END, CASE WHEN b3 THEN 'unexpected B3' END, CASE WHEN NOT told THEN 'no value_basis in B2' END], lambda x: x IS NOT NULL)) AS lacks FROM ({BOUNDS}) AS b"""
)
def bound_requirements(spark, sf_dir):
    """A document of bounds for each order; names and bases are there by key."""
    k = F.col("o_orderkey")
    named = lambda there, name, body: F.when(there, F.concat(F.lit(f'"{name}": '), body))
    basis = F.to_json(F.struct(F.col("o_orderpriority").alias("value_basis")))
    bounds = F.concat_ws(", ", named(k % 4 != 0, "B1", basis), named(F.lit(True), "B2", F.when(k % 7 != 0, basis).otherwise("{}")), named(k % 5 == 0, "B3", basis))
    documents = table(spark, sf_dir, "orders").select(k.cast("string").alias("name"), F.concat(F.lit('{"bounds": {'), bounds, F.lit("}}")).alias("text"))
    return documents.select("name", seal.requirements(F.col("text"), ["B1", "B2"]).alias("lacks"))


@query(
    """
    SELECT o_orderkey::VARCHAR AS name, list_filter([CASE WHEN o_orderkey % 6 = 0 THEN 'outcomes are not the declared ones' END, CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 9 = 0 THEN 'questions are not the declared ones in their order' END], lambda x: x IS NOT NULL) AS lacks FROM orders"""
)
def declared_questions(spark, sf_dir):
    """A document of declarations for each order; questions are out of order or missing, and outcomes missing or repeated, by key."""
    k = F.col("o_orderkey")
    questions = F.when(k % 9 == 0, "").otherwise(F.concat(F.lit('"questions": ['), F.when(k % 4 == 0, '{"id": "Q2"}, {"id": "Q1"}').otherwise('{"id": "Q1"}, {"id": "Q2"}'), F.lit("], ")))
    outcomes = F.when(k % 6 == 0, '["A"]').when(k % 2 == 0, '["B", "A", "B"]').otherwise('["A", "B"]')
    documents = table(spark, sf_dir, "orders").select(k.cast("string").alias("name"), F.concat(F.lit("{"), questions, F.lit('"outcomes": '), outcomes, F.lit("}")).alias("text"))
    return documents.select("name", seal.declarations(F.col("text"), ["Q1", "Q2"], ["A", "B"]).alias("lacks"))


@query(
    """
    SELECT o_orderkey::VARCHAR AS name, CASE WHEN o_orderkey % 31 = 0 THEN 'x' ELSE sha256(n_name) END AS binds, CASE WHEN o_orderkey % 29 = 0 THEN 'nowhere' ELSE n_name END AS pinned,
        CASE WHEN o_orderkey % 29 = 0 THEN 'nothing is pinned under this name' ELSE 'bound hash differs from the pinned one' END AS reason
    FROM orders JOIN nation ON n_nationkey = o_orderkey % 25 WHERE o_orderkey % 29 = 0 OR o_orderkey % 31 = 0"""
)
def unbound_documents(spark, sf_dir):
    """A document for each order, bound to a nation; names and hashes are broken by key."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.sha2("n_name", 256).alias("sha256"))
    k = F.col("o_orderkey")
    named = table(spark, sf_dir, "orders").select(k, (k % 25).alias("n")).join(F.broadcast(nations), F.col("n") == F.col("n_nationkey"))
    bound = F.create_map(F.when(k % 29 == 0, "nowhere").otherwise(F.col("n_name")), F.when(k % 31 == 0, "x").otherwise(F.col("sha256")))
    return seal.unbound(named.select(k.cast("string").alias("name"), F.to_json(F.struct(bound.alias("bindings"))).alias("text")), nations.select(F.col("n_name").alias("name"), "sha256"))


QUERIES, ORACLE_SQL = query.queries, query.sql
