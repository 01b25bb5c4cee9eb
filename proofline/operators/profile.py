"""Profiles of extracted values: page values, distributions, spans, constancy, locators, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import unused
from .sampling import in_order, ranked
from .scans import CHUNK, chunks


def page_value(rows: DataFrame, page: str, value: str, keep: Column) -> DataFrame:
    """(page, value, votes) for every page: its most frequent value among rows that keep holds for, the smallest of equals; null without any."""
    good = keep & F.col(value).isNotNull()
    counted = rows.groupBy(page, F.when(good, F.col(value)).alias(value)).agg(F.count_if(good).alias("n"))
    best = F.min(F.when(F.col("n") > 0, F.struct((-F.col("n")).alias("n"), F.col(value).alias("v")))).alias("x")
    return counted.groupBy(page).agg(best).select(page, F.col("x.v").alias(value), F.coalesce(-F.col("x.n"), F.lit(0)).cast("long").alias("votes"))


def state_distribution(rows: DataFrame, state: str) -> DataFrame:
    """(state, n, percent): percent of all rows with one decimal."""
    counts = rows.groupBy(state).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over a row for each state
    return counts.withColumn("percent", F.round(F.col("n") * 100.0 / total, 1))


def component_histogram(rows: DataFrame, value: str) -> DataFrame:
    """(component, n): rows by the first group of a value."""
    return rows.where(F.col(value).isNotNull()).groupBy(F.element_at(F.split(value, " "), 1).alias("component")).agg(F.count(F.lit(1)).alias("n"))


def invalid_profile(rows: DataFrame, value: str, transcribed: Column, invalid: Column) -> DataFrame:
    """One row: distinct_invalid, invalid_rows, share_percent of the transcribed ones (two decimals, null without any)."""
    bad = transcribed & invalid
    return rows.agg(
        F.count_distinct(F.when(bad, F.col(value))).alias("distinct_invalid"),
        F.count_if(bad).alias("invalid_rows"),
        F.round(F.try_divide(F.count_if(bad) * 100.0, F.count_if(transcribed)), 2).alias("share_percent"),
    )


def run_span(rows: DataFrame, run: str, value: str) -> DataFrame:
    """(run, span): highest less lowest value; null for a run without values."""
    return rows.groupBy(run).agg((F.max(value) - F.min(value)).alias("span"))


def constancy_class(rows: DataFrame, run: str, value: str, legible: Column) -> DataFrame:
    """(run, n_values, n_illegible, class): passes only if every sampled value is legible and all are equal; null values are illegible."""
    read = F.coalesce(legible, F.lit(False)) & F.col(value).isNotNull()
    seen = rows.groupBy(run).agg(F.count_distinct(F.when(read, F.col(value))).alias("n_values"), F.count_if(~read).alias("n_illegible"))
    name = (
        F.when((F.col("n_values") == 1) & (F.col("n_illegible") == 0), "CONSTANCY_SAMPLE_PASS")
        .when((F.col("n_values") > 1) & (F.col("n_illegible") > 0), "CONSTANCY_SAMPLE_FAIL_AND_UNREADABLE")
        .when(F.col("n_values") > 1, "CONSTANCY_SAMPLE_FAIL")
        .otherwise("CONSTANCY_SAMPLE_UNREADABLE_OR_AMBIGUOUS")
    )
    return seen.withColumn("class", name)


def distinct_values(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, values): each key's distinct values in order, one row a value before they are gathered: a whole list for each key, as far as one fits in a row; value_pieces() has no such bound."""
    return rows.select(key, value).where(F.col(value).isNotNull()).distinct().groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("values"))


def value_pieces(rows: DataFrame, key: str, value: str, size: int = 1000, chunk: int = CHUNK) -> DataFrame:
    """(key, piece, pieces, values): each key's distinct values in order, in numbered pieces of so many, the last of a key may have fewer; pieces tells how many the key has. A piece is a range of the key's values, so that no task holds more of a key than one."""
    each = rows.select(key, value).where(F.col(value).isNotNull()).distinct()
    ordered, i, n = ranked(each, key, value, chunk)
    pieces = F.ceil(F.col(n) / size).alias("pieces")
    return ordered.groupBy(key, F.floor(F.col(i) / size).alias("piece"), pieces).agg(F.array_sort(F.collect_list(value)).alias("values"))


def pages_by_date(headers: DataFrame, date: str, page: str) -> DataFrame:
    """(date, pages): the header pages of each date, in order. Of dates with any number of pages value_pieces() gives numbered pieces."""
    return distinct_values(headers, date, page).withColumnRenamed("values", "pages")


def medians(rows: DataFrame, part: str, value: str, chunk: int = CHUNK) -> DataFrame:
    """(part, median): the middle value of each part, the mean of both of an even number. Values are ranked chunk by chunk, so that no task and no aggregate holds a part's values; nulls don't count, and a part without any has no row."""
    ordered, i, n = ranked(rows.select(part, value).where(F.col(value).isNotNull()), part, value, chunk)
    middle = F.col(i).between(F.floor((F.col(n) - 1) / 2), F.ceil((F.col(n) - 1) / 2))
    return ordered.where(middle).groupBy(part).agg(F.avg(value).alias("median"))


def size_locator(listing: DataFrame, folder: str, size: str, share: float = 0.8, chunk: int = CHUNK) -> DataFrame:
    """With median and is_candidate: files smaller than share of their folder's median size. A folder of any number of files is ranked in chunks."""
    (f,) = unused(listing, "_f")
    middle = medians(listing, folder, size, chunk).withColumnRenamed(folder, f)
    return listing.join(middle, listing[folder].eqNullSafe(middle[f]), "left").drop(f).withColumn("is_candidate", F.coalesce(F.col(size) < F.col("median") * share, F.lit(False)))


def locator_quality(rows: DataFrame, flagged: Column, positive: Column) -> DataFrame:
    """One row: true_positive, false_positive, false_negative, precision, recall (six decimals, null where nothing is counted)."""
    f, p = F.coalesce(flagged, F.lit(False)), F.coalesce(positive, F.lit(False))
    tp, fp, fn = F.count_if(f & p), F.count_if(f & ~p), F.count_if(~f & p)
    return rows.agg(tp.alias("true_positive"), fp.alias("false_positive"), fn.alias("false_negative"), F.round(F.try_divide(tp, tp + fp), 6).alias("precision"), F.round(F.try_divide(tp, tp + fn), 6).alias("recall"))


def golden_compare(expected: DataFrame, produced: DataFrame, key: list[str], fields: list[str], order: str) -> DataFrame:
    """Each expected row with outcome MATCH, DIFFERENT or NO ROW AT THIS KEY; of produced rows that share a key the last by order counts."""
    got, *keys = unused(expected, "_got", *[f"_key{i}" for i in range(len(key))])
    last = produced.groupBy(*[F.col(k).alias(n) for k, n in zip(key, keys)]).agg(F.max_by(F.struct(*[F.col(f).alias(f"f{i}") for i, f in enumerate(fields)]), F.col(order)).alias(got))
    on, same = F.lit(True), F.lit(True)
    for k, n in zip(key, keys):
        on = on & expected[k].eqNullSafe(last[n])
    for i, f in enumerate(fields):
        same = same & F.col(f"`{f}`").eqNullSafe(F.col(got)[f"f{i}"])
    outcome = F.when(F.col(got).isNull(), "NO ROW AT THIS KEY").when(same, "MATCH").otherwise("DIFFERENT")
    return expected.join(last, on, "left").select(*[F.col(f"`{c}`") for c in expected.columns], outcome.alias("outcome"))


def match_count(compared: DataFrame) -> DataFrame:
    """One row: matched, expected, and whether every row matched: any other outcome fails."""
    n = F.count_if(F.col("outcome") == "MATCH")
    return compared.agg(n.alias("matched"), F.count(F.lit(1)).alias("expected"), (n == F.count(F.lit(1))).alias("all_match"))


def validation_outcomes(truth: DataFrame, rows: DataFrame, key: list[str], value: str = "value", state: str = "state", admissible: Column | None = None) -> DataFrame:
    """Each true row with its outcome, by exact key, once for each output row of its key, as each of them is judged: CORRECT_TRANSCRIPTION, INCORRECT_TRANSCRIPTION, STRUCTURALLY_INVALID, the extractor's own state where there is no value, or UNPAIRED. A null in a key pairs with nothing."""
    got, got_state, passes, there = unused(truth, "_value", "_state", "_ok", "_there")
    produced = rows.select(*key, F.col(value).alias(got), F.col(state).alias(got_state), (F.lit(True) if admissible is None else admissible).alias(passes), F.lit(True).alias(there))
    outcome = (
        F.when(F.col(there).isNull(), "UNPAIRED")
        .when(F.col(got).isNull(), F.col(got_state))
        .when(~F.col(passes), "STRUCTURALLY_INVALID")
        .when(F.col(got) == F.col(value), "CORRECT_TRANSCRIPTION")
        .otherwise("INCORRECT_TRANSCRIPTION")
    )
    return truth.join(produced, key, "left").select(*[F.col(f"`{c}`") for c in truth.columns], outcome.alias("outcome"))


def validation_metrics(outcomes: DataFrame) -> DataFrame:
    """One row of counts and percents (one decimal): coverage, accuracy of numeric output, accuracy of what passes the gate. A percent of nothing is null."""
    n = {k: F.count_if(F.col("outcome") == k) for k in ("CORRECT_TRANSCRIPTION", "INCORRECT_TRANSCRIPTION", "STRUCTURALLY_INVALID", "MANUAL_REVIEW_REQUIRED", "UNREADABLE", "UNPAIRED")}
    right, wrong, invalid = n["CORRECT_TRANSCRIPTION"], n["INCORRECT_TRANSCRIPTION"], n["STRUCTURALLY_INVALID"]
    percent = lambda a, b: F.round(F.try_divide(a * 100.0, b), 1)
    return outcomes.agg(
        F.count(F.lit(1)).alias("n"),
        *[c.alias(k.lower()) for k, c in n.items()],
        percent(right + wrong + invalid, F.count(F.lit(1))).alias("coverage"),
        percent(right, right + wrong + invalid).alias("accuracy_numeric"),
        percent(right, right + wrong).alias("accuracy_admissible"),
    )


def coverage_by_class(rows: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """(class, n) for every class of a closed vocabulary, 0 for those that don't occur."""
    classes = rows.sparkSession.createDataFrame([(c,) for c in domain], "class string")
    counts = rows.groupBy(F.col(column).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return classes.join(counts, "class", "left").select("class", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def bracketing(rows: DataFrame, key: str, ts: str, low: str, high: str) -> DataFrame:
    """(key, bracketed): whether a key has a time before the window and one after it."""
    return rows.groupBy(key).agg(F.coalesce(F.bool_or(F.col(ts) < F.lit(low).cast("timestamp")) & F.bool_or(F.col(ts) > F.lit(high).cast("timestamp")), F.lit(False)).alias("bracketed"))


def shift_spread(rows: DataFrame, shift: str, window: float) -> DataFrame:
    """One row: spread of a shift and what percent of a window it is (two decimals)."""
    spread = F.max(shift) - F.min(shift)
    return rows.agg(spread.alias("spread"), F.round(spread * 100.0 / window, 2).alias("percent_of_window"))


def cadence(rows: DataFrame, part: str, order: str, at: str, chunk: int = CHUNK) -> DataFrame:
    """With step, the difference from the row before, null for a part's first: a diagnosis only, which nothing here pairs or fills by.

    Parts are cut into chunks along the order, as samples are; a chunk's first row gets its neighbour from the chunk before, of which one row is known. Ties are broken by the other columns.
    """
    (last,) = unused(rows, "_last")
    cut = chunks(rows, part, order, chunk)
    inside = cut.rows.withColumn(last, F.lag(F.struct(at)).over(cut.window(*in_order(rows, order))))
    ends = cut.summary(F.max_by(F.struct(at), F.struct(*in_order(rows, order))).alias("_x"))
    enters = ends.select("_of_part", "_of_chunk", F.lag("_x").over(cut.along()).alias("_before"))
    met, before = cut.enter(inside, enters, "_before")
    return met.select(*cut.given(), (F.col(at) - F.coalesce(F.col(last), before)[at]).alias("step"))


def page_truth(values: DataFrame, truth: DataFrame, page: str, value: str) -> DataFrame:
    """(page, value, truth, outcome) for each page of truth (page, truth): MATCH, DIFFERENT, or NO CONSENSUS where values has no value for it. A page that either side has twice is judged for each pair."""
    met = truth.select(page, "truth").join(values.select(page, value), page, "left")
    outcome = F.when(F.col(value).isNull(), "NO CONSENSUS").when(F.col(value).eqNullSafe(F.col("truth")), "MATCH").otherwise("DIFFERENT")
    return met.select(page, value, "truth", outcome.alias("outcome"))


def throughput(attempts: DataFrame, at: str, ok: str, total: int) -> DataFrame:
    """One row of a run's progress from its attempts: done, failed, elapsed_s between the first and the last, per_hour (done ones) and remaining_s for what of total isn't done; null where no time has passed."""
    ended = F.unix_micros(F.col(at).cast("timestamp")) / 1e6
    good = F.coalesce(F.col(ok), F.lit(False))
    counted = attempts.agg(F.count_if(good).alias("done"), F.count_if(~good).alias("failed"), F.round(F.max(ended) - F.min(ended), 3).alias("elapsed_s"))
    left = F.greatest(F.lit(total) - F.col("done"), F.lit(0))
    return counted.select("*", F.round(F.try_divide(F.col("done") * 3600.0, F.col("elapsed_s")), 3).alias("per_hour"), F.round(F.try_divide(F.col("elapsed_s") * left, F.col("done")), 3).alias("remaining_s"))
