"""Recall in its several definitions, candidate statistics and classifier metrics.

Truth is a relation (s1_id, target_id); ``truth_pairs`` makes it of the comma lists. Each function
returns a DataFrame; nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions import tokens

PAIR = ["s1_id", "target_id"]


def truth_pairs(truth: DataFrame) -> DataFrame:
    """(source1_entity_id, matched_entity_ids) -> s1_id, target_id, repeats kept."""
    return truth.select(F.col("source1_entity_id").alias("s1_id"), F.explode(tokens.id_list(F.col("matched_entity_ids"))).alias("target_id"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 for nothing of nothing."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def recovered(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    """The true pairs among the candidates."""
    return truth.join(pairs.select(*PAIR), PAIR, "left_semi")


def missed(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    """The true pairs that aren't."""
    return truth.join(pairs.select(*PAIR), PAIR, "left_anti")


def not_indexed(truth: DataFrame, targets: DataFrame) -> DataFrame:
    """True pairs whose target doesn't exist."""
    return truth.join(targets.select(F.col("entity_id").alias("target_id")), "target_id", "left_anti").select(*PAIR)


def recall(truth: DataFrame, pairs: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """True pairs of known primary records (repeats count), distinct ones with a known target, recovered, and both recalls."""
    known = truth.join(s1.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi")
    flagged = (
        known.groupBy(*PAIR).agg(F.count("*").alias("n"))
        .join(targets.select(F.col("entity_id").alias("target_id")).distinct().withColumn("known", F.lit(1)), "target_id", "left")
        .join(pairs.select(*PAIR).distinct().withColumn("hit", F.lit(1)), PAIR, "left")
    )
    sums = flagged.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("true_pairs"), F.count("known").alias("indexed_pairs"), F.count(F.when(F.col("known").isNotNull(), F.col("hit"))).alias("recovered"))
    return sums.select("*", F.round(ratio(F.col("recovered"), F.col("true_pairs")), 9).alias("full_recall"), F.round(ratio(F.col("recovered"), F.col("indexed_pairs")), 9).alias("indexed_recall"))


def recall_over_listed(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    """R2: of everything listed, also what is unknown, blank parts included. truth has the comma lists."""
    listed = truth.select(F.coalesce(F.sum(F.size(F.split("matched_entity_ids", ","))), F.lit(0)).alias("listed"))
    hits = recovered(truth_pairs(truth), pairs).agg(F.count("*").alias("recovered"))
    both = listed.crossJoin(hits)  # one row each
    return both.select("*", F.round(ratio(F.col("recovered"), F.col("listed")), 9).alias("recall"))


def candidate_counts(pairs: DataFrame, s1: DataFrame | None = None) -> DataFrame:
    """s1_id, n: candidates by primary record; with zeros if the records are given."""
    counts = pairs.groupBy("s1_id").agg(F.count("*").alias("n"))
    if s1 is None:
        return counts
    return s1.select(F.col("entity_id").alias("s1_id")).join(counts, "s1_id", "left").select("s1_id", F.coalesce("n", F.lit(0)).alias("n"))


def distribution(counts: DataFrame, column: str = "n", quantiles: tuple[float, ...] = (0.95, 0.99)) -> DataFrame:
    """Count, mean, median, the quantiles (linear between values) and max."""
    named = [F.percentile(column, F.lit(q)).alias("p" + f"{100 * q:g}".replace(".", "_")) for q in quantiles]
    return counts.agg(F.count("*").alias("count"), F.round(F.avg(column), 9).alias("mean"), F.median(column).alias("median"), *named, F.max(column).alias("max"))


def described(rows: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """Count, mean, std, min, quartiles and max, by a column if one is named."""
    grouped = rows.groupBy(by) if by else rows.groupBy()
    quarter = [F.percentile(column, F.lit(q)).alias(f"p{round(100 * q)}") for q in (0.25, 0.5, 0.75)]
    return grouped.agg(F.count(column).alias("count"), F.round(F.avg(column), 9).alias("mean"), F.round(F.stddev_samp(column), 9).alias("std"), F.min(column).alias("min"), *quarter, F.max(column).alias("max"))


def per_record(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    """s1_id, truths, found of each primary record that has a match."""
    hit = pairs.select(*PAIR).distinct().withColumn("hit", F.lit(1))
    return truth.distinct().join(hit, PAIR, "left").groupBy("s1_id").agg(F.count("*").alias("truths"), F.count("hit").alias("found"))


def record_recall(truth: DataFrame, pairs: DataFrame, sample: DataFrame | None = None) -> DataFrame:
    """Mean, median and least recall by record, and the share of records that have some, or all, of their matches.

    The denominator of that share is the records with a match, or all of ``sample`` if it is given.
    """
    rows = per_record(truth, pairs).withColumn("recall", F.col("found") / F.col("truths"))
    sums = rows.agg(F.count("*").alias("with_match"), F.round(F.avg("recall"), 9).alias("mean"), F.median("recall").alias("median"), F.min("recall").alias("least"), F.count_if(F.expr("found > 0")).alias("some_found"), F.count_if(F.expr("found = truths")).alias("all_found"))
    if sample is not None:
        sums = sums.crossJoin(sample.agg(F.count("*").alias("records")))  # one row each
        return sums.select("*", F.round(ratio(F.col("all_found"), F.col("records")), 9).alias("all_found_ratio"))
    return sums.select("*", F.round(ratio(F.col("all_found"), F.col("with_match")), 9).alias("all_found_ratio"))


def signal_recall(truth: DataFrame, pairs: DataFrame, signals: tuple[str, ...]) -> DataFrame:
    """Recall of each signal alone and of all together (``union``), from the pairs' masks."""
    hit = truth.distinct().join(pairs.select(*PAIR, "mask"), PAIR, "left").withColumn("mask", F.coalesce("mask", F.lit(0)))
    counts = hit.agg(F.count("*").alias("truths"), *[F.count_if(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0).alias(s) for i, s in enumerate(signals)], F.count_if(F.col("mask") != 0).alias("union"))
    names = [*signals, "union"]
    rows = counts.select("truths", F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).alias("recovered")) for s in names])).alias("r"))
    return rows.select("r.signal", "r.recovered", "truths", F.round(ratio(F.col("recovered"), F.col("truths")), 9).alias("recall"))


def agreement_recall(truth: DataFrame, pairs: DataFrame, s1: DataFrame, least: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """If at least so many signals must agree: recall, candidates left, their mean by record, and by record without a match."""
    hit = truth.distinct().join(pairs.select(*PAIR, "n_signals"), PAIR, "left")
    found = hit.agg(F.count("*").alias("truths"), *[F.count_if(F.col("n_signals") >= n).alias(f"r{n}") for n in least])
    counts = pairs.groupBy("s1_id").agg(*[F.count_if(F.col("n_signals") >= n).alias(f"c{n}") for n in least])
    known = truth.select("s1_id").distinct().withColumn("matched", F.lit(True))
    each = s1.select(F.col("entity_id").alias("s1_id")).join(counts, "s1_id", "left").join(known, "s1_id", "left")
    n_left = lambda n: F.coalesce(f"c{n}", F.lit(0))
    left = each.agg(*[F.sum(n_left(n)).alias(f"c{n}") for n in least], *[F.round(F.avg(n_left(n)), 9).alias(f"m{n}") for n in least], *[F.round(F.avg(F.when(F.col("matched").isNull(), n_left(n))), 9).alias(f"s{n}") for n in least])
    names = {"recovered": "r", "candidates": "c", "mean_candidates": "m", "singleton_mean": "s"}
    rows = found.crossJoin(left).select("truths", F.explode(F.array(*[F.struct(F.lit(n).alias("least"), *[F.col(f"{x}{n}").alias(k) for k, x in names.items()]) for n in least])).alias("r"))  # one row each
    return rows.select("r.*", "truths", F.round(ratio(F.col("r.recovered"), F.col("truths")), 9).alias("recall"))


def corrected_report(truth: DataFrame, pairs: DataFrame, s1: DataFrame, targets: DataFrame, expected: int | None = None) -> DataFrame:
    """One row: true pairs of known primary records, recovered, missed, recall; pairs whose target is unknown; records with
    candidates, and the distribution of their numbers; and the sanity checks (``expected`` is the known number of true pairs)."""
    counts = candidate_counts(pairs)
    stats = distribution(counts).select(F.col("count").alias("s1_with_candidates"), F.col("mean").alias("mean_candidates"), F.col("median").alias("median_candidates"), "p95", "p99", F.col("max").alias("most_candidates"))
    sums = recall(truth, pairs, s1, targets).select("true_pairs", "recovered", F.col("full_recall").alias("recall"))
    absent = not_indexed(truth.distinct(), targets).agg(F.count("*").alias("not_indexed"))
    sizes = s1.agg(F.count("*").alias("s1_records")).crossJoin(pairs.agg(F.count("*").alias("candidate_rows")))
    rows = sums.crossJoin(stats).crossJoin(absent).crossJoin(sizes)  # one row each
    good = F.lit(None).cast("boolean") if expected is None else F.col("true_pairs") == expected
    checks = [good.alias("as_many_as_expected"), (F.col("recovered") <= F.col("true_pairs")).alias("recovered_within_truth"), F.col("recall").between(0, 1).alias("recall_within_bounds")]
    return rows.select("*", (F.col("true_pairs") - F.col("recovered")).alias("missed"), *checks)


def rank_sweep(truth: DataFrame, ranks: DataFrame, s1: DataFrame, ks: tuple[int, ...] = (10, 20, 50, 100), all_at: int = 50) -> DataFrame:
    """For each cap and k the recall among the first k by (score, id), the ceiling without ranks, the share of records all of
    whose matches are among the first ``all_at``, and the mean number of candidates. ranks: cap, s1_id, target_id, rank of the true pairs that are candidates; cap, candidates."""
    true = truth.distinct().crossJoin(F.broadcast(ranks.select("cap").distinct()))  # a handful of caps
    met = true.join(ranks.where("s1_id IS NOT NULL").select("cap", *PAIR, "rank", F.lit(1).alias("there")), ["cap", *PAIR], "left")
    each = met.groupBy("cap", "s1_id").agg(F.count("*").alias("truths"), F.count("there").alias("found"), *[F.count_if(F.col("rank") <= k).alias(f"f{k}") for k in {*ks, all_at}])
    sums = each.groupBy("cap").agg(F.sum("truths").alias("truths"), F.sum("found").alias("found"), F.count("*").alias("records"), F.count_if(F.col(f"f{all_at}") == F.col("truths")).alias("whole"), *[F.sum(f"f{k}").alias(f"f{k}") for k in ks])
    sizes = ranks.groupBy("cap").agg(F.sum("candidates").alias("candidates")).crossJoin(s1.agg(F.count("*").alias("n_s1")))
    rows = sums.join(sizes, "cap").select(
        "cap", F.round(ratio(F.col("found"), F.col("truths")), 9).alias("ceiling"), F.round(ratio(F.col("whole"), F.col("records")), 9).alias("all_found_ratio"), F.round(ratio(F.col("candidates"), F.col("n_s1")), 9).alias("mean_candidates"),
        "truths", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"f{k}").alias("recovered")) for k in ks])).alias("r"),
    )
    return rows.select("cap", "r.k", "ceiling", "all_found_ratio", "mean_candidates", "r.recovered", F.round(ratio(F.col("r.recovered"), F.col("truths")), 9).alias("recall"))


def signal_sweep(truth: DataFrame, pairs: DataFrame, s1: DataFrame) -> DataFrame:
    """Recall and mean candidates by record for each cap and signal, and for all together (``union``). pairs: cap, s1_id, target_id, sig."""
    each = pairs.select("cap", "sig", *PAIR).unionByName(pairs.select("cap", F.lit("union").alias("sig"), *PAIR).distinct())
    true = truth.distinct().withColumn("hit", F.lit(1))
    sums = each.join(true, PAIR, "left").groupBy("cap", "sig").agg(F.count("*").alias("candidates"), F.count("hit").alias("recovered"))
    totals = truth.distinct().agg(F.count("*").alias("truths")).crossJoin(s1.agg(F.count("*").alias("n_s1")))
    rows = sums.crossJoin(F.broadcast(totals))  # one row
    return rows.select("cap", F.col("sig").alias("signal"), "recovered", F.round(ratio(F.col("recovered"), F.col("truths")), 9).alias("recall"), F.round(ratio(F.col("candidates"), F.col("n_s1")), 9).alias("mean_candidates"))


def setting_report(truth: DataFrame, pairs: DataFrame, s1: DataFrame) -> DataFrame:
    """A18, A9 of one setting: recall, the share of records with a match that have all, and the distribution of candidates by record, zeros included; and its mean by record without a match."""
    counts = candidate_counts(pairs, s1).join(truth.select("s1_id").distinct().withColumn("matched", F.lit(True)), "s1_id", "left")
    alone = counts.agg(F.round(F.avg(F.when(F.col("matched").isNull(), F.col("n"))), 9).alias("singleton_mean"))
    hits = per_record(truth, pairs).agg(F.sum("truths").alias("truths"), F.sum("found").alias("recovered"), F.count("*").alias("records"), F.count_if(F.expr("found = truths")).alias("whole"))
    rows = distribution(counts).crossJoin(alone).crossJoin(hits)  # one row each
    return rows.select(F.round(ratio(F.col("recovered"), F.col("truths")), 9).alias("recall"), F.round(ratio(F.col("whole"), F.col("records")), 9).alias("all_found_ratio"), "mean", "p95", "p99", "max", "singleton_mean")


def recall_at(truth: DataFrame, ranked: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """For each k the true pairs among the first k, and the records all of whose matches are there."""
    hit = truth.distinct().join(ranked.select(*PAIR, "rank"), PAIR, "left")
    each = hit.groupBy("s1_id").agg(F.count("*").alias("truths"), *[F.count_if(F.col("rank") <= k).alias(f"f{k}") for k in ks])
    sums = each.agg(F.sum("truths").alias("truths"), F.count("*").alias("records"), *[F.sum(f"f{k}").alias(f"f{k}") for k in ks], *[F.count_if(F.col(f"f{k}") == F.col("truths")).alias(f"a{k}") for k in ks])
    rows = sums.select("truths", "records", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"f{k}").alias("recovered"), F.col(f"a{k}").alias("all_found")) for k in ks])).alias("r"))
    return rows.select("r.k", "r.recovered", "truths", "r.all_found", "records", F.round(ratio(F.col("recovered"), F.col("truths")), 9).alias("recall"), F.round(ratio(F.col("all_found"), F.col("records")), 9).alias("all_found_ratio"))


def unranked_recall(truth: DataFrame, found: DataFrame, ks: tuple[int, ...] = (10, 25, 50, 100, 250, 500)) -> DataFrame:
    """Without ranks every k has all true pairs that were found."""
    sums = truth.agg(F.count("*").alias("truths")).crossJoin(recovered(truth, found).agg(F.count("*").alias("recovered")))  # one row each
    each = sums.select(F.explode(F.lit(list(ks))).alias("k"), "recovered", "truths")
    return each.withColumn("recall", F.round(ratio(F.col("recovered"), F.col("truths")), 9))


def lift(truth: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Recalls of two candidate sets, extra pairs and extra true pairs of the second, growth, and the verdict by the lift."""
    flag = lambda pairs, name: pairs.select(*PAIR).distinct().withColumn(name, F.lit(1))
    pairs = flag(before, "a").join(flag(after, "b"), PAIR, "full").join(truth.distinct().withColumn("t", F.lit(1)), PAIR, "full")
    sums = pairs.agg(
        F.count("t").alias("truths"), F.count("a").alias("pairs_before"), F.count("b").alias("pairs_after"), F.count(F.when(F.col("a").isNull(), F.col("b"))).alias("extra_pairs"),
        F.count(F.when(F.col("t").isNotNull(), F.col("a"))).alias("recovered_before"), F.count(F.when(F.col("t").isNotNull(), F.col("b"))).alias("recovered_after"),
        F.count(F.when(F.col("t").isNotNull() & F.col("a").isNull(), F.col("b"))).alias("extra_true_pairs"),
    )
    gain = ratio(F.col("recovered_after"), F.col("truths")) - ratio(F.col("recovered_before"), F.col("truths"))
    return sums.select("*", F.round(gain, 9).alias("lift"), F.round(ratio(F.col("pairs_after"), F.col("pairs_before")), 9).alias("growth"), F.when(gain >= 0.01, "KEEP").when(gain >= 0.005, "POSSIBLY").otherwise("DROP").alias("verdict"))


def histogram(rows: DataFrame, column: str) -> DataFrame:
    """Each value's count and share in percent."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(column, "n", F.round(100 * F.col("n") / F.col("total"), 6).alias("percent"))  # total is one row


def block_sizes(keys: DataFrame) -> DataFrame:
    """Distribution of the number of records a key has."""
    return distribution(keys.groupBy("sig", "key").agg(F.count("*").alias("n")), quantiles=(0.5, 0.75, 0.9, 0.95, 0.99, 0.999))


#: Thresholds 0.10, 0.11, ... 0.95.
THRESHOLDS = tuple(round(0.10 + 0.01 * i, 2) for i in range(86))


def threshold_sweep(scored: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, beta: float = 0.5) -> DataFrame:
    """Threshold, tp, fp, fn, tn, precision, recall, f for each threshold; scored has label (0 or 1) and probability.

    Rows are first counted by how many thresholds they pass, so the sweep runs over a hundred rows.
    """
    passed = F.size(F.filter(F.lit(list(thresholds)), lambda t: t <= F.col("probability")))
    counts = scored.groupBy(passed.alias("passed"), "label").agg(F.count("*").alias("n"))
    steps = scored.sparkSession.createDataFrame([(i, t) for i, t in enumerate(thresholds)], "place int, threshold double")
    sums = steps.join(F.broadcast(counts), how="cross").groupBy("place", "threshold").agg(
        F.sum(F.when((F.col("label") == 1) & (F.col("passed") > F.col("place")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when((F.col("label") == 0) & (F.col("passed") > F.col("place")), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when((F.col("label") == 1) & (F.col("passed") <= F.col("place")), F.col("n")).otherwise(0)).alias("fn"),
        F.sum(F.when((F.col("label") == 0) & (F.col("passed") <= F.col("place")), F.col("n")).otherwise(0)).alias("tn"),
    )
    tp, b2 = F.col("tp").cast("double"), beta * beta
    measures = [F.round(ratio(tp, tp + F.col("fp")), 9).alias("precision"), F.round(ratio(tp, tp + F.col("fn")), 9).alias("recall"), F.round(ratio((1 + b2) * tp, (1 + b2) * tp + b2 * F.col("fn") + F.col("fp")), 9).alias("f")]
    return sums.select("threshold", "tp", "fp", "fn", "tn", *measures)


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The row of the greatest f; the lowest threshold where it ties."""
    return sweep.orderBy(F.col("f").desc(), "threshold").limit(1)


def class_ratio(rows: DataFrame) -> DataFrame:
    """Negatives, positives and their ratio."""
    sums = rows.agg(F.count_if(F.expr("label = 0")).alias("negatives"), F.count_if(F.expr("label = 1")).alias("positives"))
    return sums.select("*", F.round(ratio(F.col("negatives"), F.col("positives")), 9).alias("ratio"))
