"""Evaluation: retrieval metrics, judged accuracy, paired tests, intervals, diversity, budgets and costs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..session import checkpointed, ship
from .names import named

KS = (1, 3, 5, 10)
SEMANTIC = 0.70
# The categories that the headline counts.
HEADLINE = ("multi-hop", "temporal", "open-domain", "single-hop")


def without_parents(results: DataFrame) -> DataFrame:
    """results: query_id, rank, text, parents. Results that are a parent's text go before ranks are given anew."""
    rows = results.where(~F.exists(F.col("parents"), lambda p: T.norm(p) == T.norm(F.col("text"))))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def retrieval_metrics(hits: DataFrame, ks: tuple[int, ...] = KS, places: int = 6) -> DataFrame:
    """hits: query_id, rank, hit (0 or 1). Of each query precision (over what was returned), any hit at each k, and the reciprocal rank."""
    out = []
    for k in ks:
        inside = F.col("rank") <= k
        n = F.count_if(inside)
        out += [F.round(F.coalesce(F.try_divide(F.sum(F.when(inside, F.col("hit")).otherwise(0)), n), F.lit(0.0)), places).alias(f"precision_{k}"), F.coalesce(F.max(F.when(inside, F.col("hit"))), F.lit(0)).cast("int").alias(f"hit_{k}")]
    first = F.min(F.when(F.col("hit") == 1, F.col("rank")))
    return hits.groupBy("query_id").agg(*out, F.round(F.coalesce(1.0 / first, F.lit(0.0)), places).alias("mrr"))


def semantic_hit(results: DataFrame, expected: DataFrame, k: int, threshold: float = SEMANTIC) -> DataFrame:
    """results: query_id, rank, embedding; expected: query_id, embedding. Whether one of the first k comes near an expected vector."""
    e = expected.select("query_id", F.col("embedding").alias("wanted"))
    near = results.where(F.col("rank") <= k).join(e, "query_id").groupBy("query_id").agg(F.round(F.max(V.cosine(F.col("embedding"), F.col("wanted"))), 6).alias("best"))
    return near.withColumn("hit", (F.col("best") >= threshold).cast("int"))


def evidence_recall(rows: DataFrame, empty_counts: bool = True) -> DataFrame:
    """rows: question_id, evidence, retrieved (arrays). The share of the evidence found, and whether all was; without evidence 1, or no row."""
    if not empty_counts:
        rows = rows.where(F.size("evidence") > 0)
    found = F.size(F.array_intersect("evidence", "retrieved")) / F.size(F.array_distinct("evidence"))
    share = F.when(F.size("evidence") == 0, 1.0).otherwise(found)
    return rows.select("question_id", F.round(share, 6).alias("hit_rate"), (F.size(F.array_except("evidence", "retrieved")) == 0).cast("int").alias("full"))


def mcnemar(pairs: DataFrame) -> DataFrame:
    """pairs: a_correct, b_correct (0 or 1) of the same questions. b, c, and the continuity-corrected chi-square (0 without discord)."""
    b, c = F.count_if((F.col("a_correct") == 1) & (F.col("b_correct") == 0)), F.count_if((F.col("a_correct") == 0) & (F.col("b_correct") == 1))
    chi = F.when(b + c == 0, 0.0).otherwise(F.pow(F.abs(b - c) - 1, F.lit(2)) / (b + c))
    return pairs.agg(F.count("*").alias("n"), b.alias("b"), c.alias("c"), F.round(chi, 6).alias("chi2"))


def mcnemar_p(chi2: Column, places: int = 6) -> Column:
    """The chance of a chi-square as large with one degree of freedom: erfc of the root of its half, by the power series of erf (exact to ``places`` up to the root 4; beyond, the chance is under 2e-8)."""
    x = F.sqrt(F.greatest(chi2, F.lit(0.0)) / 2)
    # each term is the one before times -x^2 / n, over 2n + 1
    term = lambda acc, n: F.struct((acc["t"] * -x * x / n).alias("t"), (acc["s"] + acc["t"] * -x * x / n / (2 * n + 1)).alias("s"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(80)), F.struct(x.alias("t"), x.alias("s")), term, lambda acc: acc["s"])
    return F.when(x >= 4, 0.0).otherwise(F.round(1 - 2 / F.sqrt(F.lit(math.pi)) * series, places) + 0.0)


def paired(results: DataFrame) -> DataFrame:
    """results: system, question_id, correct. Each two systems on the questions that both answered."""
    a, b = results.alias("a"), results.alias("b")
    both = a.join(b, (F.col("a.question_id") == F.col("b.question_id")) & (F.col("a.system") < F.col("b.system")))
    return both.select(F.col("a.system").alias("system_a"), F.col("b.system").alias("system_b"), F.col("a.correct").alias("a_correct"), F.col("b.correct").alias("b_correct"))


def rollup(results: DataFrame, places: int = 6) -> DataFrame:
    """results: config, category, score. By category and in all (null category): mean and number; one pass of grouping sets."""
    return results.rollup("config", "category").agg(F.round(F.avg("score"), places).alias("mean_score"), F.count("*").alias("n"), F.grouping_id().alias("g")).where("g < 3").drop("g")


def headline(results: DataFrame, places: int = 6) -> DataFrame:
    """The mean over headline categories, and that of adversarial questions (null without any)."""
    own = F.col("category").isin(*HEADLINE)
    return results.groupBy("config").agg(F.round(F.avg(F.when(own, F.col("score"))), places).alias("headline"), F.round(F.avg(F.when(F.col("category") == "adversarial", F.col("score"))), places).alias("adversarial"), F.count("*").alias("n"))


def macro(results: DataFrame, places: int = 6) -> DataFrame:
    """The mean of the categories' means."""
    each = results.groupBy("config", "category").agg(F.avg("score").alias("m"))
    return each.groupBy("config").agg(F.round(F.avg("m"), places).alias("macro"))


def bootstrap(values: DataFrame, by: str = "config", resamples: int = 1000, seed: int = 42, places: int = 6) -> DataFrame:
    """mean and the 2.5 and 97.5 percentiles of the resampled means of each group's values, rounded to ``places``.

    Values are counted first, so a task holds a group's distinct values only; a resample is a multinomial draw of their
    counts, which has the same distribution as drawing row by row.
    """
    import pandas as pd

    ship(values.sparkSession)

    def one(rows):
        rows = rows.sort_values("value")
        v, c = rows["value"].to_numpy(dtype=float), rows["n"].to_numpy(dtype=np.int64)
        n = int(c.sum())
        rng = np.random.default_rng(seed)
        means = np.array([rng.multinomial(n, c / n) @ v / n for _ in range(resamples)])
        return pd.DataFrame({by: [rows[by].iloc[0]], "mean": [float(c @ v / n)], "low": [np.percentile(means, 2.5)], "high": [np.percentile(means, 97.5)], "n": [n]})

    counted = values.select(F.col(by).cast("string").alias(by), F.round(F.col("value").cast("double"), places).alias("value")).groupBy(by, "value").agg(F.count("*").alias("n"))
    return counted.groupBy(by).applyInPandas(lambda rows: one(rows), f"{by} string, mean double, low double, high double, n bigint")


#: A prime below 2 ** 31; the chances of a Poisson(1) draw of 0, of at most 1, and so on, in parts of it.
DRAW_PRIME = (1 << 31) - 1
DRAW_CUTS = tuple(int(DRAW_PRIME * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(8))


def poisson_bootstrap(values: DataFrame, by: str = "config", key: str = "question_id", resamples: int = 1000, seed: int = 42, places: int = 6) -> DataFrame:
    """mean, and the 2.5 and 97.5 percentiles of the resampled means, of each group's values rounded to ``places``; n.

    Every row is drawn Poisson(1) times in every resample, so rows are drawn apart from one another and a group may lie
    in any number of tasks: each keeps one array of partial sums, all resamples at once. The draws come from the row's
    ``key`` alone (by a hash with ``seed``, as a polynomial in the resample's number), so a repeated run or another
    partitioning draws the same, and so can SQL. Values are summed as whole numbers of the last place: the sums are exact.
    Null values are left out; a resample that draws nothing has no mean.
    """
    ship(values.sparkSession)
    hashed = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)
    part = lambda k: F.conv(F.substring(hashed, 1 + 7 * k, 7), 16, 10).cast("bigint")
    rows = values.select(F.col(by).cast("string").alias(by), F.round(F.col("value").cast("double") * 10**places).cast("bigint").alias("value"), *[part(k).alias(f"h{k}") for k in range(3)]).where("value IS NOT NULL")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.arange(resamples, dtype=np.int64)
        held: dict[str | None, tuple[np.ndarray, np.ndarray, int, int]] = {}
        for batch in batches:
            groups = batch.column(0).to_pylist()
            value, *h = (batch.column(k).to_numpy() for k in range(1, 5))
            for g in dict.fromkeys(groups):
                own = np.flatnonzero([x == g for x in groups])
                total, drawn, plain, n = held.get(g, (np.zeros(resamples, np.int64), np.zeros(resamples, np.int64), 0, 0))
                for lo in range(0, len(own), 2048):
                    i = own[lo : lo + 2048]
                    u = (h[0][i, None] + h[1][i, None] * r + h[2][i, None] * (r * r)) % DRAW_PRIME
                    times = np.searchsorted(DRAW_CUTS, u.ravel(), side="right").reshape(u.shape)
                    total, drawn = total + value[i] @ times, drawn + times.sum(axis=0)
                held[g] = total, drawn, plain + int(value[own].sum()), n + len(own)
        for g, (total, drawn, plain, n) in held.items():
            columns = [pa.array([g] * resamples, pa.string()), pa.array(r), pa.array(total), pa.array(drawn), pa.array(np.full(resamples, plain)), pa.array(np.full(resamples, n))]
            yield pa.RecordBatch.from_arrays(columns, names=[by, "r", "total", "drawn", "plain", "n"])

    each = rows.mapInArrow(sums, f"{by} string, r bigint, total bigint, drawn bigint, plain bigint, n bigint").groupBy(by, "r").agg(*[F.sum(c).alias(c) for c in ("total", "drawn", "plain", "n")])
    mean = F.when(F.col("drawn") > 0, F.col("total") / F.col("drawn"))
    scale = F.lit(float(10**places))
    bound = lambda q: (F.percentile(mean, F.lit(q)) / scale)
    return each.groupBy(by).agg((F.first("plain") / F.first("n") / scale).alias("mean"), bound(0.025).alias("low"), bound(0.975).alias("high"), F.first("n").alias("n"))


def diversity(sets: DataFrame, places: int = 6) -> DataFrame:
    """sets: pair_id, seed, ids (the top k). Mean Jaccard over each two seeds (empty unions count 0, no two seeds 1)."""
    a, b = sets.alias("a"), sets.alias("b")
    both = a.join(b, (F.col("a.pair_id") == F.col("b.pair_id")) & (F.col("a.seed") < F.col("b.seed")))
    union = F.size(F.array_union("a.ids", "b.ids"))
    jaccard = F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect("a.ids", "b.ids")) / union)
    mean = both.groupBy(F.col("a.pair_id").alias("pair_id")).agg(F.avg(jaccard).alias("m"))
    return sets.select("pair_id").distinct().join(mean, "pair_id", "left").select("pair_id", F.round(F.coalesce("m", F.lit(1.0)), places).alias("jaccard"))


def extraction_audit(recorded: DataFrame, gold: DataFrame, days: float = 45.0) -> DataFrame:
    """recorded, gold: entity, value, at. Precision, recall and the share of matches within ``days``: values match if one core holds the other.

    The distinct values are held against one another by an automaton, either way, so only those that do match meet; rows
    meet by entity and value, and no row meets another. A recorded row is judged by its first match by (at, value). An
    empty core is held by all; a null value matches nothing.
    """
    r = recorded.select("entity", F.col("at").alias("r_at"), T.answer_core(F.col("value")).alias("rv"))
    g = gold.select("entity", F.struct("at", "value").alias("gid"), T.answer_core(F.col("value")).alias("gv"))
    by_rv, by_gv = r.where("rv IS NOT NULL").select("entity", "rv").distinct(), g.where("gv IS NOT NULL").groupBy("entity", "gv").agg(F.min("gid").alias("gid"))
    rvs, gvs = by_rv.select("rv").distinct(), by_gv.select("gv").distinct()
    held = named(rvs.withColumn("said", F.col("rv")), gvs.select(F.col("gv").alias("name")), "rv", "said").select("rv", F.col("name").alias("gv"))
    holds = named(gvs.withColumn("said", F.col("gv")), rvs.select(F.col("rv").alias("name")), "gv", "said").select(F.col("name").alias("rv"), "gv")
    same = F.contains("rv", F.col("gv")) | F.contains("gv", F.col("rv"))  # folds may be wider
    pairs = held.unionByName(holds).where(same).distinct()
    met = checkpointed(by_rv.join(pairs, "rv").join(by_gv, ["entity", "gv"]).select("entity", "rv", "gv", "gid"))
    least = by_gv.groupBy("entity").agg(F.min("gid").alias("gid"), F.min(F.when(F.col("gv") == "", F.col("gid"))).alias("bare"))
    empty = by_rv.where("rv = ''").join(least, "entity").select("entity", "rv", "gid")
    bare = by_rv.join(least.where("bare IS NOT NULL"), "entity").select("entity", "rv", F.col("bare").alias("gid"))
    first = met.select("entity", "rv", "gid").unionByName(empty).unionByName(bare).groupBy("entity", "rv").agg(F.min("gid").alias("gid"))
    hits = r.join(first, ["entity", "rv"]).agg(F.count("*").alias("hits"), F.count_if(F.abs(F.col("r_at") - F.col("gid.at")) <= days * 86400).alias("close"))
    all_of = by_rv.groupBy("entity").agg(F.bool_or(F.col("rv") == "").alias("has_empty"))
    told = g.where("gv IS NOT NULL").select("entity", "gid", "gv").distinct().join(met.select("entity", "gv").distinct().withColumn("_met", F.lit(True)), ["entity", "gv"], "left").join(all_of, "entity")
    found = told.agg(F.count_if(F.coalesce("_met", F.lit(False)) | F.col("has_empty") | (F.col("gv") == "")).alias("found"))
    sizes = r.agg(F.count("*").alias("n_recorded")).join(g.agg(F.count("*").alias("n_gold"))).join(hits).join(found)  # one row each
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return sizes.select(share("hits", "n_recorded").alias("precision"), share("found", "n_gold").alias("recall"), share("close", "hits").alias("in_time"))


#: Values that a column's range is cut at in each round of the search for a place.
CUTS = 64


def value_at(rows: DataFrame, column: str, place: int):
    """The value at a place (from 0) of a column in order, without nulls, exactly; and how many rows lie before the first of that value.

    Each round cuts the range at approximate quantiles, counts every piece and goes on in the one with the place; a cut is
    a piece of its own, so each round leaves less, and a task leaves ``2 * CUTS + 1`` counts at most.
    """
    c, before = F.col(column), 0
    rows = rows.where(c.isNotNull())
    while True:
        cuts = rows.agg(F.percentile_approx(c, [k / CUTS for k in range(1, CUTS)], 1000)).first()[0]
        cuts = F.array(*[F.lit(x) for x in sorted(set(cuts))])
        piece = 2 * F.size(F.filter(cuts, lambda x: x < c)) + F.when(F.array_contains(cuts, c), F.lit(1)).otherwise(F.lit(0))
        for p in rows.groupBy(piece.alias("piece")).agg(F.count("*").alias("n"), F.min(c).alias("low"), F.max(c).alias("high")).orderBy("piece").collect():  # a row a piece
            if before + p["n"] > place:
                break
            before += p["n"]
        if p["low"] == p["high"]:
            return p["low"], before
        rows = rows.where((c >= p["low"]) & (c <= p["high"]))


def scaling(rows: DataFrame, places: int = 6) -> DataFrame:
    """rows: size, delta. Their correlation, and the mean delta of the smaller and the larger half, by (size, delta); equal rows are in one half.

    The last row of the smaller half is found by ``value_at``, by its size and then by its delta: no task orders rows.
    Rows with a null are left out.
    """
    rows = rows.select("size", "delta").where("size IS NOT NULL AND delta IS NOT NULL")
    n = rows.count()
    if not n:
        return rows.agg(*[F.lit(None).cast("double").alias(c) for c in ("pearson", "small_half", "large_half")])
    last = -(-(n - 1) // 2) - 1 if n > 1 else 0  # place, from 0, of the last row with fewer than half of the others before it
    size, before = value_at(rows, "size", last)
    delta, _ = value_at(rows.where(F.col("size") == F.lit(size)), "delta", last - before)
    small = F.lit(True) if n == 1 else (F.col("size") < F.lit(size)) | (F.col("size") == F.lit(size)) & (F.col("delta") <= F.lit(delta))
    return rows.agg(F.round(F.try_divide(F.covar_pop("size", "delta"), F.stddev_pop("size") * F.stddev_pop("delta")), places).alias("pearson"), F.round(F.avg(F.when(small, F.col("delta"))), places).alias("small_half"), F.round(F.avg(F.when(~small, F.col("delta"))), places).alias("large_half"))


def store_audit(notes: DataFrame, slots: DataFrame) -> DataFrame:
    """notes: scope, rank, content; slots: scope, old, new. Of each slot: notes that still assert the old value, notes that assert the new one, and whether the first note does."""
    j = slots.join(notes, "scope", "left")
    stale, now = F.coalesce(T.asserts(F.col("content"), F.col("old"), F.col("new")), F.lit(False)), F.coalesce(T.asserts(F.col("content"), F.col("new"), F.col("old")), F.lit(False))
    return j.groupBy("scope", "old", "new").agg(F.count_if(stale).alias("stale"), F.count_if(now).alias("current"), F.coalesce(F.max(F.when(F.col("rank") == 1, now.cast("int"))), F.lit(0)).alias("top1"))


def histogram(observations: DataFrame, recent: int = 1024, places: int = 6) -> DataFrame:
    """observations: name, seq, value. Count, sum and mean of each name, and mean and maximum of its last ``recent``."""
    every = observations.groupBy("name").agg(F.count("*").alias("count"), F.round(F.sum("value"), 4).alias("sum"), F.round(F.avg("value"), places).alias("mean"))
    # of a name in very many tasks each part leaves its last ones only, and the parts' last ones give the name's
    part = observations.withColumn("_part", F.pmod(F.xxhash64("seq"), F.lit(64)))
    latest = lambda rows, *keys: rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("seq")))).where(F.col("_n") <= recent).drop("_n")
    new = latest(latest(part, "name", "_part").drop("_part"), "name").groupBy("name").agg(F.round(F.avg("value"), places).alias("recent_mean"), F.round(F.max("value"), places).alias("recent_max"))
    return every.join(new, "name", "left")


def newest(errors: DataFrame, n: int = 50) -> DataFrame:
    """The last ``n`` errors, newest first: a report of so many rows."""
    return errors.orderBy(F.desc("ts"), F.desc("message")).limit(max(0, n))


def error_fingerprint(kind: Column, frames: Column, most: int = 5) -> Column:
    """Tells errors of one kind from one place, whatever they say: a hash of the kind and the last ``most`` frames (file:line)."""
    last = F.slice(frames, F.greatest(F.size(frames) - most + 1, F.lit(1)), most)
    return F.substring(F.sha2(F.concat_ws("|", kind, F.array_join(last, "|")), 256), 1, 16)


def operator_scores(scores: DataFrame, places: int = 6) -> DataFrame:
    """scores: operator, pair_id, and a column for each metric. The mean of each metric by operator, over its pairs."""
    metrics = [c for c in scores.columns if c not in ("operator", "pair_id")]
    return scores.groupBy("operator").agg(*[F.round(F.avg(c), places).alias(c) for c in metrics], F.count("*").alias("n"))


def operator_intervals(scores: DataFrame, metric: str, **how) -> DataFrame:
    """scores as for ``operator_scores``. The bootstrap interval of a metric by operator, or by encoder and operator where there are encoders."""
    by = F.concat_ws("/", "encoder", "operator") if "encoder" in scores.columns else F.col("operator")
    return poisson_bootstrap(scores.select(by.alias("operator"), F.col(metric).alias("value"), "pair_id"), "operator", "pair_id", **how)


def differing(overlaps: DataFrame, threshold: float = 0.5, places: int = 6) -> DataFrame:
    """overlaps: operator, jaccard (``diversity`` of each pair). The mean overlap, and the share of pairs below the threshold."""
    return overlaps.groupBy("operator").agg(F.round(F.avg("jaccard"), places).alias("mean_overlap"), F.round(F.avg((F.col("jaccard") < threshold).cast("double")), places).alias("differing"), F.count("*").alias("n_pairs"))


def system_summary(metrics: DataFrame, places: int = 6) -> DataFrame:
    """metrics: system, ms, and ``retrieval_metrics`` of each query. One row for each system: the mean of each metric, queries, mean milliseconds."""
    own = [c for c in metrics.columns if c.startswith(("precision_", "hit_")) or c == "mrr"]
    return metrics.groupBy("system").agg(*[F.round(F.avg(c), places).alias(c) for c in own], F.count("*").alias("total_queries"), F.round(F.avg("ms"), places).alias("mean_ms"))


def only_in(found: DataFrame, others: DataFrame) -> DataFrame:
    """query_id, id of what a search found and another didn't."""
    return found.select("query_id", "id").join(others.select("query_id", "id"), ["query_id", "id"], "left_anti")


def tallies(turns: DataFrame) -> DataFrame:
    """turns: scope, session, is_gold, text. Of each scope: sessions, turns, turns that hold an answer, tokens."""
    return turns.groupBy("scope").agg(F.count_distinct("session").alias("n_sessions"), F.count("*").alias("n_turns"), F.count_if("is_gold").alias("n_gold"), F.sum(T.n_tokens(F.col("text"))).alias("n_tokens"))


def error_groups(errors: DataFrame) -> DataFrame:
    """errors: fingerprint, ts, message. Count and the latest message of each, most frequent first."""
    return errors.groupBy("fingerprint").agg(F.count("*").alias("n"), F.max_by("message", "ts").alias("last_message")).orderBy(F.desc("n"), "fingerprint")


def cost(usage: DataFrame, price_in: float, price_out: float) -> Column:
    """Price of tokens, prices for a million."""
    return F.round((F.col("tokens_in") * price_in + F.col("tokens_out") * price_out) / 1e6, 9)


def yearly_cost(messages_a_month: Column | float, cost_a_message: Column | float) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return F.round(lit(messages_a_month) * 12 * lit(cost_a_message), 2)


def stratified_head(rows: DataFrame, n: int, kinds: int, by: str = "category", order: str = "question_id") -> DataFrame:
    """The first n // kinds rows of each kind."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_n") <= n // kinds).drop("_n")
