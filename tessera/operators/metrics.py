"""Evaluation and meter aggregates (G-08..G-18, G-21, G-22, G-26..G-28,
G-30..G-36, J-08).

Everything reduces with map-side partial aggregation; no operator here
brings rows to the driver.  ANSI mode is on, so ratios use ``try_divide``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ids import running_total

LN2 = math.log(2.0)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def avg_meter(df: DataFrame, by: Sequence[str], val: str, n: str) -> DataFrame:
    """G-08: weighted mean sum(val*n)/sum(n) per group, with sum and count."""
    return df.groupBy(*by).agg(
        F.sum(_c(val) * _c(n)).alias("sum"), F.sum(n).alias("count"),
        F.try_divide(F.sum(_c(val) * _c(n)), F.sum(n)).alias("avg"))


def rate_meter(df: DataFrame, by: Sequence[str], n: str, ts: str) -> DataFrame:
    """G-09: items per second between the first and last timestamp, and the
    stopwatch view (total and mean duration between consecutive events)."""
    t = F.col(ts).cast("timestamp")
    secs = F.unix_micros(F.max(t)) - F.unix_micros(F.min(t))
    return df.groupBy(*by).agg(
        F.sum(n).alias("n"), (secs / 1e6).alias("elapsed"),
        F.try_divide(F.sum(n).cast("double"), secs / 1e6).alias("rate"),
        F.try_divide(secs / 1e6, F.count(F.lit(1)) - 1).alias("avg_interval"))


def loss_summary(df: DataFrame, by: Sequence[str], loss: str, nll: str, sample_size: str,
                 ntokens: str, nsentences: str, ncorrect: str | None = None, base2: bool = True) -> DataFrame:
    """G-10: criterion roll-up: loss per sample-size unit and nll per token
    (in bits when ``base2``), accuracy = correct / sentences; zero-size safe."""
    scale = LN2 if base2 else 1.0
    cols = [F.sum(loss).alias("loss_sum"), F.sum(sample_size).alias("sample_size"),
            F.sum(ntokens).alias("ntokens"), F.sum(nsentences).alias("nsentences"),
            (F.try_divide(F.sum(loss), F.sum(sample_size)) / scale).alias("loss"),
            (F.try_divide(F.sum(nll), F.sum(ntokens)) / scale).alias("nll_loss")]
    if ncorrect is not None:
        cols.append(F.try_divide(F.sum(ncorrect).cast("double"), F.sum(nsentences)).alias("accuracy"))
    return df.groupBy(*by).agg(*cols)


def perplexity(loss_sum: Column, n: Column, base2: bool = False) -> Column:
    """G-12: exp(sum loss / n) (1e9 when n = 0); base-2 form 2**x, inf on overflow."""
    x = F.try_divide(loss_sum, n)
    if base2:
        return F.when(n == 0, F.lit(1e9)).otherwise(
            F.when(x * LN2 > 709.0, F.lit(float("inf"))).otherwise(F.pow(F.lit(2.0), x)))
    return F.when(n == 0, F.lit(1e9)).otherwise(
        F.when(x > 709.0, F.lit(float("inf"))).otherwise(F.exp(x)))


def pearson(x, y) -> Column:
    """G-14: population Pearson over the rows where both sides are present;
    NULL for constant input (no division error)."""
    x, y = _c(x), _c(y)
    xs, ys = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(xs, ys), F.stddev_pop(xs) * F.stddev_pop(ys))


def float_bucket(col, per_octave: int = 64) -> Column:
    """A monotone integer bucket for any double (log scale, sign aware)."""
    v = _c(col)
    # log2 of a non-zero double is above -1075, so the offset keeps g >= 1
    g = F.greatest(F.lit(1), F.floor(F.log2(F.abs(v)) * per_octave) + 1100 * per_octave)
    return F.when(v == 0, F.lit(0)).otherwise(F.signum(v).cast("long") * g.cast("long"))


def average_ranks(df: DataFrame, col: str, out: str) -> DataFrame:
    """Tie-averaged 1-based ranks of ``col`` without a global window: the
    value histogram (map-side combined) is prefix-summed with the two-phase
    method, then joined back on the value."""
    hist = df.groupBy(col).agg(F.count(F.lit(1)).alias("_cnt"))
    ranked = running_total(hist, [F.col(col)], fine=[float_bucket(col, 4096)], coarse=[float_bucket(col, 1)],
                           value="_cnt", out="_before", inclusive=False)
    ranks = ranked.select(col, (F.col("_before") + (F.col("_cnt") + 1) / 2.0).alias(out))
    return df.join(ranks, col)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """G-15: Pearson of tie-averaged ranks."""
    r = average_ranks(average_ranks(df, x, "_rx"), y, "_ry")
    return r.agg(pearson("_rx", "_ry").alias("spearman"))


def confusion(pred: Column, gold: Column):
    tp = F.sum(F.when((pred == 1) & (gold == 1), 1).otherwise(0)).cast("double")
    tn = F.sum(F.when((pred != 1) & (gold != 1), 1).otherwise(0)).cast("double")
    fp = F.sum(F.when((pred == 1) & (gold != 1), 1).otherwise(0)).cast("double")
    fn = F.sum(F.when((pred != 1) & (gold == 1), 1).otherwise(0)).cast("double")
    return tp, tn, fp, fn


def tag_scores(df: DataFrame, pred: str, gold: str, threshold: float = 0.5) -> DataFrame:
    """G-16: binarise predictions (> threshold), confusion counts, F1 of
    class 0 and class 1, MCC (0 when its denominator is 0).  Products are
    formed in DOUBLE so they cannot overflow."""
    p = F.when(_c(pred) > threshold, 1).otherwise(0)
    tp, tn, fp, fn = confusion(p, _c(gold))
    c = df.agg(tp.alias("tp"), tn.alias("tn"), fp.alias("fp"), fn.alias("fn"))
    den = F.sqrt((F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn"))
                 * (F.col("tn") + F.col("fp")) * (F.col("tn") + F.col("fn")))
    return c.select(
        F.col("tp").cast("long").alias("tp"), F.col("tn").cast("long").alias("tn"),
        F.col("fp").cast("long").alias("fp"), F.col("fn").cast("long").alias("fn"),
        F.coalesce(F.try_divide(2 * F.col("tn"), 2 * F.col("tn") + F.col("fp") + F.col("fn")), F.lit(0.0)).alias("f1_bad"),
        F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)).alias("f1_ok"),
        F.when(den == 0, F.lit(0.0)).otherwise(
            (F.col("tp") * F.col("tn") - F.col("fp") * F.col("fn")) / den).alias("mcc"))


def clf_scores(df: DataFrame, pred: str, gold: str, binary: bool) -> DataFrame:
    """G-17: accuracy, F1 (binary for two classes, else micro) and the
    multiclass MCC, all x100.  The confusion matrix is reduced to one row per
    class k (true total t_k, predicted total p_k, diagonal c_kk), and a
    single aggregate over that table gives every score."""
    cm = df.groupBy(F.col(gold).alias("g"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).cast("double").alias("c"))
    per_class = (cm.select(F.col("g").alias("k"), F.col("c").alias("t"), F.lit(0.0).alias("pp"),
                           F.when(F.col("g") == F.col("p"), F.col("c")).otherwise(0.0).alias("d"))
                 .unionByName(cm.select(F.col("p").alias("k"), F.lit(0.0).alias("t"), F.col("c").alias("pp"),
                                        F.lit(0.0).alias("d")))
                 .groupBy("k").agg(F.sum("t").alias("t"), F.sum("pp").alias("pp"), F.sum("d").alias("d")))
    tot = per_class.agg(
        F.sum("t").alias("s"), F.sum("d").alias("cor"), F.sum(F.col("t") * F.col("pp")).alias("tp_sum"),
        F.sum(F.col("t") ** 2).alias("t2"), F.sum(F.col("pp") ** 2).alias("p2"),
        F.sum(F.when(F.col("k") == 1, F.col("d")).otherwise(0.0)).alias("tp1"),
        F.sum(F.when(F.col("k") == 1, F.col("pp") - F.col("d")).otherwise(0.0)).alias("fp1"),
        F.sum(F.when(F.col("k") == 1, F.col("t") - F.col("d")).otherwise(0.0)).alias("fn1"))
    den = F.sqrt((F.col("s") ** 2 - F.col("p2")) * (F.col("s") ** 2 - F.col("t2")))
    f1 = (F.coalesce(F.try_divide(2 * F.col("tp1"), 2 * F.col("tp1") + F.col("fp1") + F.col("fn1")), F.lit(0.0))
          if binary else F.col("cor") / F.col("s"))
    return tot.select((100.0 * F.col("cor") / F.col("s")).alias("acc"), (100.0 * f1).alias("f1"),
                      (100.0 * F.when(den == 0, F.lit(0.0)).otherwise(
                          (F.col("cor") * F.col("s") - F.col("tp_sum")) / den)).alias("mcc"))


def accuracy_by(df: DataFrame, by: Sequence[str], pred: str, gold: str) -> DataFrame:
    """G-18: 100 * correct / total per group."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.when(_c(pred) == _c(gold), 1).otherwise(0)).cast("long").alias("valid"),
        (100.0 * F.sum(F.when(_c(pred) == _c(gold), 1).otherwise(0)) / F.count(F.lit(1))).alias("acc"))


def mse(pred, gold) -> Column:
    """G-21: squared error per row."""
    return (_c(pred) - _c(gold)) ** 2


def bce(logit, target) -> Column:
    """G-21: binary cross entropy with logits (stable form)."""
    x, z = _c(logit), _c(target)
    return F.greatest(x, F.lit(0.0)) - x * z + F.log1p(F.exp(-F.abs(x)))


def smoothed_nll(lprob_target: Column, lprob_sum: Column, eps: float, vocab: int):
    """G-21: label-smoothed loss (1-eps)*nll + eps/V * smooth, and nll."""
    nll = -lprob_target
    smooth = -lprob_sum
    return (1.0 - eps) * nll + (eps / vocab) * smooth, nll


def quantile_loss(pred, gt, w: float) -> Column:
    """G-22: ((1-w)[m>0] - w[m<=0]) * m with m = gt - pred."""
    m = _c(gt) - _c(pred)
    return F.when(m > 0, (1.0 - w) * m).otherwise(-w * m)


def score_join(pred: DataFrame, gold: DataFrame, key: str = "id"):
    """J-08: predictions joined to gold by id, plus the ids without a match
    on either side (anti joins)."""
    matched = pred.join(gold, key)
    missing_gold = pred.join(gold, key, "left_anti").select(key)
    missing_pred = gold.join(pred, key, "left_anti").select(key)
    return matched, missing_gold, missing_pred


def score_join_left(pred: DataFrame, gold: DataFrame, key: str = "id") -> DataFrame:
    """J-08 in one pass: every prediction with its gold value (NULL when
    missing), so matched and missing counts come from one aggregate."""
    return pred.join(gold, key, "left")


def usage_histogram(df: DataFrame, slot: str, weight: str | None, slots: DataFrame) -> DataFrame:
    """G-26: per-slot usage (weighted or counted), normalised, over the full
    slot universe (unused slots are 0)."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    used = df.groupBy(slot).agg(F.sum(w).alias("u"))
    h = slots.join(used, slot, "left").select(slot, F.coalesce("u", F.lit(0.0)).alias("u"))
    tot = h.agg(F.sum("u")).first()[0] or 0.0
    return h.select(slot, F.col("u"), (F.col("u") / F.lit(tot if tot else 1.0)).alias("p"))


def usage_stats(hist: DataFrame, slot: str, p: str = "p") -> DataFrame:
    """G-27: share of used slots, KL to uniform, Gini and the number of slots
    holding the top 50/90/99 % of mass, from one exclusive prefix sum in
    descending order (two-phase, never a global window).  With D the mass of
    strictly larger slots, the ascending cumulative sum is total - D."""
    x = F.col("x")
    neg = x * -1.0
    base = hist.select(slot, F.col(p).alias("x"))
    desc = running_total(base, [neg, -F.col(slot)], fine=[float_bucket(neg, 4096)],
                         coarse=[float_bucket(neg, 1)], value="x", out="d", inclusive=False)
    a = desc.agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("tot"), F.avg("d").alias("mean_d"),
                 F.sum(F.when(x != 0, 1).otherwise(0)).alias("used"),
                 F.sum(F.when(x > 0, x * F.log(x)).otherwise(0.0)).alias("xlx"),
                 *[F.sum(F.when(F.col("d") <= 1.0 - q, 1).otherwise(0)).alias(f"top{name}")
                   for q, name in ((0.5, 50), (0.1, 90), (0.01, 99))])
    return a.select((100.0 * F.col("used") / F.col("n")).alias("used_pct"),
                    (F.log(F.col("n")) + F.col("xlx")).alias("kl_uniform"),
                    (1.0 - 2.0 * (F.col("tot") - F.col("mean_d"))).alias("gini"),
                    F.col("top50").cast("long").alias("top50"), F.col("top90").cast("long").alias("top90"),
                    F.col("top99").cast("long").alias("top99"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """G-28: inverse class frequency, normalised to sum to 1."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    inv = c.select(label, (1.0 / F.col("n")).alias("w"))
    tot = inv.agg(F.sum("w")).first()[0]
    return inv.select(label, (F.col("w") / F.lit(tot)).alias("weight"))


def sampling_probs(df: DataFrame, key: str, alpha: float) -> DataFrame:
    """G-30: p_k proportional to n_k, then p^alpha renormalised (alpha=-1: off)."""
    c = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(0))  # one row per key: a tiny table
    p = c.select(key, "n", (F.col("n") / F.sum("n").over(w)).alias("p"))
    if alpha == -1:
        return p.select(key, "n", F.col("p").alias("prob"))
    q = p.select(key, "n", F.pow("p", F.lit(alpha)).alias("q"))
    return q.select(key, "n", (F.col("q") / F.sum("q").over(w)).alias("prob"))


def logsumexp(df: DataFrame, by: Sequence[str], x: str, out: str = "lse") -> DataFrame:
    """W-05: numerically stable log(sum(exp(x))) per group (two passes over
    the group, both partial-aggregated)."""
    m = df.groupBy(*by).agg(F.max(x).alias("_m"))
    return (df.join(m, list(by)).groupBy(*by)
            .agg((F.first("_m") + F.log(F.sum(F.exp(F.col(x) - F.col("_m"))))).alias(out)))
