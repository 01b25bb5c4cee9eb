"""License scans by a positional index of rare words, with DataFrame functions only.

Templates are phrases, which must stand word for word (bare licence names, whose every place counts, and the key phrases of licences), and bodies, whole
licence texts that files hold edited or cut. All documents give each template word its IDF. In a file the licence words that it has are ordered by IDF; the highest of
a template's words among them are looked up in the template, and the places where the template would begin by one word are intersected with those by the
others: a phrase begins where its two rarest words agree, and a body may begin where two of its RARE_WORDS rarest words of the file agree. Phrases are then verified word
for word. Bodies are looked at only where one of their key phrases stands; the words that stand at their relative places from any such beginning must make up LEAST_SHARE of the
body's IDF. A file is scanned in its own row: no file, word or line gathers rows anywhere, and the index is of fixed size.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, WORD_GAP, words
from .license_texts import BODIES, NAMES, PHRASES

#: A file's words of a body that are looked up, those of highest IDF; words that the body has more often than MOST_PLACES are not.
RARE_WORDS, MOST_PLACES = 16, 3
#: The share of a body's IDF that must stand at its places.
LEAST_SHARE = 0.5

Body = tuple[str, str, list[str]]


def plain_words(text: str) -> list[str]:
    """A text's words, as words() has them."""
    return [w for w in re.split(WORD_GAP, text.translate(str.maketrans(UPPER, LOWER))) if w]


def phrases_of(bodies: list[Body] = BODIES) -> list[dict]:
    """All phrases that are looked up, each once: names, phrases with a label, and key phrases, which may have none."""
    found: dict[str, dict] = {}
    for text, label, base in [*((t, x, True) for t, x in NAMES), *((t, x, False) for t, x in PHRASES), *((k, None, False) for b in bodies for k in b[2])]:
        own = plain_words(text)
        if len(set(own)) < 2:
            raise ValueError(f"a phrase needs two different words: {text}")
        found.setdefault(" ".join(own), {"words": own, "label": label, "base": base})
    return [*found.values()]


def word_counts(docs_words: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """The number of documents (rows of docs_words, words in column _w), and of those with each word of the vocabulary. One count a word reaches the driver."""
    wanted = F.array(*map(F.lit, vocabulary))
    counted = docs_words.select(F.explode(F.concat(F.array_intersect("_w", wanted), F.array(F.lit("")))).alias("word")).groupBy("word").count()
    n = {r["word"]: r["count"] for r in counted.collect()}
    return n.get("", 0), {w: n.get(w, 0) for w in vocabulary}


def _table(rows: list[dict], schema: str) -> Column:
    """A small table as one value."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bodies: list[Body] = BODIES) -> DataFrame:
    """({id_col}, n_words, places, labels, base_labels, score): a row for each row of docs.

    places are (start, end, label, base, share) in words, in order: every place of a phrase that has a label, with share 1, and for each body that is found the words from its first
    beginning to its last end, with the share of its IDF that stands there. score is the highest share of all that was looked up, whether it was enough or not; 0 without any. A null or empty
    text has no words. Repeated rows and null ids stay, other columns aren't returned. Without documents there are no rows.

    bodies: (text, label, key phrases). They are sent with the plan, so that they must be few (licences, not files).
    """
    phrases, texts = phrases_of(bodies), [plain_words(b[0]) for b in bodies]
    split = docs.select(F.col(id_col).alias("_id"), words(F.col(text_col)).alias("_w"))
    n_docs, count = word_counts(split, sorted({w for t in [*(p["words"] for p in phrases), *texts] for w in t}))
    idf = {w: math.log((1 + n_docs) / (1 + n)) + 1 for w, n in count.items()}
    by_idf = sorted(idf, key=lambda w: (count[w], w))
    rank = {w: i for i, w in enumerate(by_idf)}

    rows = []
    for p in phrases:
        a, b = sorted(set(p["words"]), key=rank.get)[:2]
        rows.append({"words": p["words"], "a": a, "a_at": p["words"].index(a), "b": b, "b_at": p["words"].index(b), "label": p["label"], "base": p["base"]})
    phrase_table = _table(rows, "words: array<string>, a: string, a_at: int, b: string, b_at: int, label: string, base: boolean")
    index_of = {" ".join(p["words"]): i for i, p in enumerate(phrases)}
    rows = []
    for own, (_, label, keys) in zip(texts, bodies):
        total = sum(idf[w] for w in own)
        rare = sorted({w for w in own if own.count(w) <= MOST_PLACES}, key=rank.get)
        rows.append({"words": own, "weights": [idf[w] / total for w in own], "rare": rare, "keys": [index_of[" ".join(plain_words(k))] for k in keys], "label": label})
    body_table = _table(rows, "words: array<string>, weights: array<double>, rare: array<string>, keys: array<int>, label: string")

    n, w = F.size("_w"), F.col("_w")
    places_of = lambda x: F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, i) == x)

    def phrase_starts(p: Column) -> Column:
        begun = F.array_intersect(F.transform(places_of(p["a"]), lambda i: i - p["a_at"]), F.transform(places_of(p["b"]), lambda i: i - p["b_at"]))
        return F.filter(begun, lambda s: (s >= 0) & (F.slice(w, F.greatest(s, F.lit(0)) + 1, F.size(p["words"])) == p["words"]))

    def body_found(b: Column) -> Column:
        own, size = b["words"], F.size(b["words"])
        in_body = lambda x: F.filter(F.sequence(F.lit(0), size - 1), lambda j: F.get(own, j) == x)
        begun = F.transform(F.slice(F.array_intersect(b["rare"], F.col("_has")), 1, RARE_WORDS), lambda x: F.array_distinct(F.flatten(F.transform(places_of(x), lambda i: F.transform(in_body(x), lambda j: i - j)))))
        # A beginning that two words name stands twice.
        agreed = F.transform(F.array(F.array_sort(F.flatten(begun))), lambda v: F.array_distinct(F.filter(v, lambda x, i: (i > 0) & (F.get(v, F.greatest(i, F.lit(1)) - 1) == x))))
        met = F.transform(agreed, lambda v: F.struct(v.alias("starts"), F.array_distinct(F.flatten(F.transform(v, lambda s: F.filter(F.sequence(F.lit(0), size - 1), lambda j: (s + j >= 0) & (F.get(w, s + j) == F.get(own, j)))))).alias("at")))
        share = lambda at: F.round(F.least(F.aggregate(F.array_sort(at), F.lit(0.0), lambda total, j: total + F.get(b["weights"], j)), F.lit(1.0)), 6)
        return F.transform(
            met,
            lambda m: F.struct(
                F.greatest(F.coalesce(F.array_min(m["starts"]), F.lit(0)), F.lit(0)).alias("start"),
                F.least(F.coalesce(F.array_max(m["starts"]), F.lit(0)) + size, n).alias("end"),
                b["label"].alias("label"),
                F.lit(False).alias("base"),
                share(m["at"]).alias("share"),
            ),
        )

    has = split.withColumn("_has", F.array_intersect(F.array(*map(F.lit, by_idf)), w))  # in the order of by_idf
    numbered = F.filter(
        F.transform(phrase_table, lambda p, i: F.struct(i.alias("i"), p["label"].alias("label"), p["base"].alias("base"), F.size(p["words"]).alias("size"), F.when(F.array_contains("_has", p["a"]) & F.array_contains("_has", p["b"]), phrase_starts(p)).alias("starts"))),
        lambda x: F.coalesce(F.size(x["starts"]), F.lit(-1)) > 0,
    )
    found = has.select("_id", "_w", "_has", numbered.alias("phrases"))
    keys_there = F.transform("phrases", lambda x: x["i"])
    looked = F.flatten(F.transform(F.filter(body_table, lambda b: F.arrays_overlap(b["keys"], keys_there)), body_found))
    at_phrases = F.flatten(F.transform(F.filter("phrases", lambda x: x["label"].isNotNull()), lambda x: F.transform(x["starts"], lambda s: F.struct(s.alias("start"), (s + x["size"]).alias("end"), x["label"].alias("label"), x["base"].alias("base"), F.lit(1.0).alias("share")))))
    none = F.array().cast("array<struct<start:int,end:int,label:string,base:boolean,share:double>>")
    found = found.select("_id", n.cast("long").alias("n_words"), at_phrases.alias("named"), F.when(F.size("phrases") > 0, looked).otherwise(none).alias("looked"))
    found = found.withColumn("places", F.array_sort(F.concat("named", F.filter("looked", lambda x: x["share"] >= LEAST_SHARE))))
    return found.select(
        F.col("_id").alias(id_col),
        "n_words",
        "places",
        F.array_sort(F.array_distinct(F.transform("places", lambda x: x["label"]))).alias("labels"),
        F.array_sort(F.array_distinct(F.transform(F.filter("places", lambda x: x["base"]), lambda x: x["label"]))).alias("base_labels"),
        F.coalesce(F.array_max(F.transform(F.concat("named", "looked"), lambda x: x["share"])), F.lit(0.0)).alias("score"),
    )


def op9(docs: DataFrame) -> DataFrame:
    """The digest of scan_licenses() that op9_licenses returns: places of the bare names are the base."""
    base = F.filter("places", lambda x: x["base"])
    starts = F.transform(base, lambda x: x["start"].cast("long"))
    return scan_licenses(docs).select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def _sql_list(items: list) -> str:
    return "[" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in items) + "]"


_PHRASES = phrases_of()
_KEYS = [[next(i for i, p in enumerate(_PHRASES) if p["words"] == plain_words(k)) for k in keys] for _, _, keys in BODIES]
_PHRASE_VALUES = ", ".join(f"({i}, {_sql_list(p['words'])}, {'NULL' if p['label'] is None else repr(p['label'])}, {p['base']})" for i, p in enumerate(_PHRASES))
_BODY_VALUES = ", ".join(f"({i}, {_sql_list(plain_words(text))}, '{label}', {_sql_list(keys)})" for i, ((text, label, _), keys) in enumerate(zip(BODIES, _KEYS)))
OP9_SQL = rf"""
WITH t AS (SELECT * FROM (VALUES {_PHRASE_VALUES}) AS v(t, words, label, base)),
b AS (SELECT * FROM (VALUES {_BODY_VALUES}) AS v(b, words, label, keys)),
d AS (
    SELECT doc_id, row_number() OVER () AS r,
        list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
    FROM documents
),
place AS (SELECT r, unnest(generate_series(0, len(w) - 1)) AS p, unnest(w) AS word FROM d WHERE len(w) > 0),
body_words AS (SELECT b, unnest(generate_series(0, len(words) - 1)) AS j, unnest(words) AS word FROM b),
frequency AS (SELECT word, count(DISTINCT r) AS n FROM place WHERE word IN (SELECT word FROM body_words) GROUP BY word),
idf AS (SELECT word, coalesce(n, 0) AS n, ln((1 + (SELECT count(*) FROM d)) / (1 + coalesce(n, 0))) + 1 AS idf FROM (SELECT DISTINCT word FROM body_words) AS x LEFT JOIN frequency USING (word)),
weights AS (SELECT b, j, word, idf / sum(idf) OVER (PARTITION BY b) AS weight FROM body_words JOIN idf USING (word)),
named AS (SELECT d.r, t.t, p AS start, t.label, t.base FROM t JOIN place ON place.word = t.words[1] JOIN d ON d.r = place.r WHERE d.w[p + 1:p + len(t.words)] = t.words),
candidate AS (SELECT DISTINCT named.r, b.b FROM named JOIN b ON list_contains(b.keys, named.t)),
rare AS (
    SELECT r, b, word FROM (
        SELECT r, b, word, row_number() OVER (PARTITION BY r, b ORDER BY n, word) AS k
        FROM candidate JOIN (SELECT b, word FROM body_words GROUP BY b, word HAVING count(*) <= {MOST_PLACES}) AS x USING (b) JOIN idf USING (word) SEMI JOIN place USING (r, word)
    ) AS y WHERE k <= {RARE_WORDS}
),
begun AS (
    SELECT r, b, start FROM (SELECT DISTINCT rare.r, rare.b, rare.word, p - j AS start FROM rare JOIN place USING (r, word) JOIN body_words AS bw ON bw.b = rare.b AND bw.word = rare.word) AS x
    GROUP BY r, b, start HAVING count(*) >= 2
),
matched AS (SELECT DISTINCT begun.r, begun.b, w.j, w.weight FROM begun JOIN weights AS w ON w.b = begun.b JOIN place ON place.r = begun.r AND place.p = begun.start + w.j AND place.word = w.word),
looked AS (
    SELECT candidate.r, b.label, round(least(coalesce(sum(weight), 0), 1), 6) AS share
    FROM candidate JOIN b USING (b) LEFT JOIN matched ON matched.r = candidate.r AND matched.b = candidate.b GROUP BY candidate.r, candidate.b, b.label
),
every AS (
    SELECT r, label, base, start, 1.0 AS share FROM named WHERE label IS NOT NULL
    UNION ALL SELECT r, label, false, NULL, share FROM looked
),
found AS (
    SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word, max(share) AS score,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (share >= {LEAST_SHARE}) AS labels
    FROM every GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN found USING (r)
"""
