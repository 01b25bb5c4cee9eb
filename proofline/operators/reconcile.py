"""Exact reconciliation of two extracted sides.

Rows pair by identity alone, page and row together: never by nearness, value, order or tolerance. Both sides are gathered in one grouping by the key, which collapses
each to one row a key, so that duplicates never multiply; the last row of a key, by a stated order, stands for it. No join is needed to pair them, and what else decides, pages that one side lacks, is a short
list that is broadcast, so that rows are shuffled once; where it isn't short (BROADCAST_PAGES), Spark shuffles what was paired a second time, by page.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import RA_FIELDS, SIDE_FIELDS, VERDICTS

# Version and reasons.
JOINER_VERSION = "join_radec_v1"
DUPLICATE = "row_y appears more than once on this page"
#: Pages of one side alone are sent to all tasks up to so many; beyond it Spark joins them by shuffling.
BROADCAST_PAGES = 100_000
INDEX_DIFFERS = "row_index differs between sides (%s vs %s); pairing is by geometry, the index disagreement is recorded only"


@dataclass(frozen=True)
class Sides:
    """What the columns are called. shared: columns that come from the left row where there is one, else from the right; order: what says which row of a key is last."""

    page: str = "page"
    row: str = "row_y"
    order: str = "line_no"
    index: str = "row_index"
    left: str = "dec"
    right: str = "ra"
    left_fields: tuple[str, ...] = tuple(SIDE_FIELDS)
    right_fields: tuple[str, ...] = tuple(RA_FIELDS)
    shared: tuple[str, ...] = ("run", "folder", "source_url")

    @property
    def name(self) -> dict[str, str]:
        return {"left": self.left.upper(), "right": self.right.upper()}


def keyed(left: DataFrame, right: DataFrame, s: Sides) -> DataFrame:
    """(page, row, l_copies, r_copies, l, r): one row a key, with each side's number of rows and its last row's fields. A null row is a page's records that stand for no row."""

    def of(side: DataFrame, name: str, fields: tuple[str, ...]) -> DataFrame:
        x = F.struct(*dict.fromkeys([s.index, *fields, *s.shared]))
        return side.select(F.col(s.page).alias("page"), F.col(s.row).alias("row"), F.lit(name).alias("side"), x.alias(name), F.col(s.order).alias(f"{name}_order"))

    both = of(left, "l", s.left_fields).unionByName(of(right, "r", s.right_fields), allowMissingColumns=True)
    copies = [F.count_if(F.col("side") == n).alias(f"{n}_copies") for n in "lr"]
    return both.groupBy("page", "row").agg(*copies, *[F.max_by(n, f"{n}_order").alias(n) for n in "lr"])


def page_sides(left: DataFrame, right: DataFrame, s: Sides = Sides()) -> DataFrame:
    """(page, in_left, in_right) for every page of either side; page-level records make their page present."""
    marked = left.select(F.col(s.page).alias("page"), F.lit(True).alias("l")).distinct().unionByName(right.select(F.col(s.page).alias("page"), F.lit(False).alias("l")).distinct())
    return marked.groupBy("page").agg(F.bool_or("l").alias("in_left"), F.bool_or(~F.col("l")).alias("in_right"))


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


def _one_sided(left: DataFrame, right: DataFrame, s: Sides) -> DataFrame:
    """The pages that one side lacks altogether: a list that is sent to all tasks if it is short."""
    pages = page_sides(left, right, s).where("in_left <> in_right").select(F.col("page").alias("_page"), F.lit(True).alias("_alone"))
    found = pages.limit(BROADCAST_PAGES + 1).collect()
    return F.broadcast(left.sparkSession.createDataFrame(found, pages.schema).coalesce(1)) if len(found) <= BROADCAST_PAGES else pages


def reconcile(left: DataFrame, right: DataFrame, s: Sides = Sides()) -> DataFrame:
    """One record for each key of either side: page, row, the shared columns, pairing_verdict, pairing_reason, row_index_agreement, joiner_version, a struct of each side's fields
    (null where the side has no row), and how many copies of the key each side had.

    A key that a side holds more than once is unresolved, whatever the other side has. Null pages are one page. Row indexes are compared, null with null
    agreeing, and never decide. Which pages a side lacks is looked up at once, from the page columns alone.
    """
    met = keyed(left, right, s).where("row is not null")
    met = met.join(_one_sided(left, right, s), F.col("page").eqNullSafe(F.col("_page")), "left")
    has_l, has_r = F.col("l_copies") > 0, F.col("r_copies") > 0
    twice = (F.col("l_copies") > 1) | (F.col("r_copies") > 1)
    left_only, right_only = f"UNPAIRED_{s.name['left']}_ONLY", f"UNPAIRED_{s.name['right']}_ONLY"
    verdict = (
        F.when(twice, "PAIRING_UNRESOLVED")
        .when(has_l & has_r, "PAIRED")
        .when(F.col("_alone"), "PAGE_MISSING_ON_OTHER_SIDE")
        .otherwise(F.when(has_l, left_only).otherwise(right_only))
    )
    paired = F.col("pairing_verdict") == "PAIRED"
    li, ri = F.col("l")[s.index], F.col("r")[s.index]
    agreement = F.when(paired, F.when(li.eqNullSafe(ri), "AGREE").otherwise("DIFFER"))
    other = F.when(has_l, F.lit(s.name["right"])).otherwise(F.lit(s.name["left"]))
    reason = (
        F.when(F.col("pairing_verdict") == "PAIRING_UNRESOLVED", DUPLICATE)
        .when(F.col("row_index_agreement") == "DIFFER", F.format_string(INDEX_DIFFERS, _text(li), _text(ri)))
        .when(F.col("pairing_verdict") == "PAGE_MISSING_ON_OTHER_SIDE", F.concat(F.lit("page absent from the "), other, F.lit(" side")))
        .when(~paired, F.concat(F.lit("no "), other, F.lit(" row with this exact row_y on this page")))
    )
    met = met.withColumn("pairing_verdict", verdict).withColumn("row_index_agreement", agreement).withColumn("pairing_reason", reason)
    return met.select(
        F.col("page").alias(s.page),
        F.col("row").alias(s.row),
        *[F.when(has_l, F.col("l")[c]).otherwise(F.col("r")[c]).alias(c) for c in s.shared],
        "pairing_verdict",
        "pairing_reason",
        "row_index_agreement",
        F.lit(JOINER_VERSION).alias("joiner_version"),
        F.when(has_l, F.struct(*[F.col("l")[c].alias(c) for c in s.left_fields])).alias(s.left),
        F.when(has_r, F.struct(*[F.col("r")[c].alias(c) for c in s.right_fields])).alias(s.right),
        F.col("l_copies").alias(f"{s.left}_copies"),
        F.col("r_copies").alias(f"{s.right}_copies"),
    )


def verdict_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("pairing_verdict").agg(F.count(F.lit(1)).alias("n"))


def per_page_counts(records: DataFrame, page: str = "page") -> DataFrame:
    """A column of counts for each verdict, by page."""
    counts = [F.count_if(F.col("pairing_verdict") == v).alias(v.lower()) for v in VERDICTS]
    return records.groupBy(page).agg(*counts)


def summary(left: DataFrame, right: DataFrame, s: Sides = Sides()) -> DataFrame:
    """One row of counts: keys, page-level records, duplicated keys and pages of either side, pages of one side only, verdicts, index disagreements.

    Keys are counted page by page; a page tells which of its sides is there, so that its unpaired keys need nothing else to be judged.
    """
    l, r = s.left, s.right
    row, twice = F.col("row").isNotNull(), (F.col("l_copies") > 1) | (F.col("r_copies") > 1)
    has = {n: row & (F.col(f"{n}_copies") > 0) for n in "lr"}
    paired = has["l"] & has["r"] & ~twice
    by_page = (
        keyed(left, right, s)
        .groupBy("page")
        .agg(
            *[(F.sum(f"{n}_copies") > 0).alias(f"in_{n}") for n in "lr"],
            *[F.sum(F.when(~row, F.col(f"{n}_copies")).otherwise(0)).alias(f"level_{n}") for n in "lr"],
            *[F.count_if(has[n]).alias(f"rows_{n}") for n in "lr"],
            *[F.count_if(row & (F.col(f"{n}_copies") > 1)).alias(f"twice_{n}") for n in "lr"],
            F.count_if(paired).alias("paired"),
            F.count_if(row & twice).alias("unresolved"),
            F.count_if(has["l"] & ~has["r"] & ~twice).alias("only_l"),
            F.count_if(has["r"] & ~has["l"] & ~twice).alias("only_r"),
            F.count_if(paired & ~F.col("l")[s.index].eqNullSafe(F.col("r")[s.index])).alias("differ"),
        )
    )
    # A list of pages leaves out what has no name.
    named = F.col("page").isNotNull() & (F.col("page").cast("string") != "")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    both = F.col("in_l") & F.col("in_r")
    return by_page.agg(
        *[total(f"rows_{n}").alias(f"{k}_rows_indexed") for n, k in (("l", l), ("r", r))],
        *[total(f"twice_{n}").alias(f"duplicate_row_y_{k}") for n, k in (("l", l), ("r", r))],
        total("paired").alias("n_paired"),
        total("unresolved").alias("n_pairing_unresolved"),
        total(F.when(both, F.col("only_l"))).alias(f"n_unpaired_{l.lower()}_only"),
        total(F.when(both, F.col("only_r"))).alias(f"n_unpaired_{r.lower()}_only"),
        total(F.when(~both, F.col("only_l") + F.col("only_r"))).alias("n_page_missing_on_other_side"),
        total("differ").alias("row_index_disagreements_among_paired"),
        *[total(f"level_{n}").alias(f"{k}_page_level_records_skipped") for n, k in (("l", l), ("r", r))],
        F.count_if("in_l").alias(f"pages_{l}"),
        F.count_if("in_r").alias(f"pages_{r}"),
        F.count(F.lit(1)).alias("pages_either_side"),
        F.count_if(F.col("in_l") & ~F.col("in_r") & named).alias(f"n_pages_only_{l}"),
        F.count_if(F.col("in_r") & ~F.col("in_l") & named).alias(f"n_pages_only_{r}"),
    )


def pages_of_one_side(left: DataFrame, right: DataFrame, s: Sides = Sides()) -> DataFrame:
    """(page, side): named pages that one side lacks altogether; side is the one that has them."""
    sides = page_sides(left, right, s).where("in_left <> in_right and page is not null and cast(page as string) <> ''")
    return sides.select("page", F.when(F.col("in_left"), s.left).otherwise(s.right).alias("side"))


def in_output_order(records: DataFrame, s: Sides = Sides()) -> DataFrame:
    """By page as text, a null page sorting as None, then by row."""
    return records.orderBy(_text(F.col(s.page)), s.row)


def duplicate_keys(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def last_of_each_key(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row of highest order for each key; of an order's ties the greatest other columns, as far as they have an order, so that the choice is the same on every run."""
    rest = [c for c in rows.columns if c not in key]
    ties = [c for c, kind in rows.dtypes if c in rest and c != order and "map<" not in kind and "variant" not in kind]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(order, *ties)).alias("x")).select(*key, "x.*")
