"""Survival analysis: event/duration builder, Cox proportional hazards (Efron ties, ridge),
survival curves for profiles, and exposure-band exponential curves.

Cox fitting is Newton's method on standardised covariates. Each step is:
1. one grouped aggregate by duration over the collapsed rows (equal time, event and covariates count as one with a
   weight): event count d, and sums of w = exp(x b), x w, x x' w over all rows and over the events at that
   time; the event sums of x do not change and are taken once;
2. risk-set sums (rows with duration >= t) as chunked running sums over the per-time
   table in descending duration (no single-task window);
3. Efron's tie correction needs one term per tied event: (time, l) rows come from a
   two-level ``explode`` (blocks, then events in a block) so a time with many ties is
   spread over tasks instead of one huge array;
4. gradient and Hessian are one more aggregate: p + p^2 numbers reach the driver.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import clip
from .windows import chunked_running, range_chunk, range_edges

EFRON_BLOCK = 10000


def event_duration(df: DataFrame, cls: str = "GradeClass", event_class: int = 4, exposure: str = "Absences",
                   max_time: float = 40.0, noise_sd: float = 0.0, id_col: str | None = None, seed=42) -> DataFrame:
    """Event = class == event_class; duration = max_time * (1 - minmax(exposure)) (+ noise), clipped
    to [1, max_time]; rows without the event are censored at max_time. An event without exposure has
    no duration (null).

    Noise (optional) is Box-Muller from md5 of the row id, so it is reproducible anywhere.
    """
    r = df.agg(F.min(exposure).alias("lo"), F.max(exposure).alias("hi")).first()
    lo, hi = (float(r[k] or 0.0) for k in ("lo", "hi"))     # without any exposure no event has a duration
    norm = F.when(F.col(exposure).isNotNull(), F.coalesce(F.try_divide(F.col(exposure) - F.lit(lo), F.lit(hi - lo)), F.lit(0.0)))
    dur = F.lit(max_time) * (F.lit(1.0) - norm)
    if noise_sd and id_col:
        h = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"-{seed}")))
        u1 = (F.conv(F.substring(h, 1, 12), 16, 10).cast("double") + 1) / F.lit(float(16 ** 12 + 1))
        u2 = F.conv(F.substring(h, 13, 12), 16, 10).cast("double") / F.lit(float(16 ** 12))
        dur = dur + F.lit(noise_sd) * F.sqrt(-2 * F.log(u1)) * F.cos(2 * math.pi * u2)
    dur = clip(dur, 1.0, max_time)
    event = (F.col(cls) == F.lit(event_class)).cast("int")
    return df.withColumns({"Event": event, "Duration": F.when(event == 1, dur).otherwise(F.lit(max_time))})


def _cox_step(d: DataFrame, xs: Sequence[str], beta: np.ndarray, duration: str, event: str, edges: list, at_events: np.ndarray):
    """Log likelihood, gradient and Hessian from one scan of the collapsed rows (``_n`` equal ones each)."""
    p = len(xs)
    eta = sum(F.lit(float(beta[i])) * F.col(x) for i, x in enumerate(xs)) if p else F.lit(0.0)
    w = F.col("_n") * F.exp(eta)
    ev = F.col(event) == 1
    aggs = [F.sum(w).alias("a0"), F.sum(F.when(ev, w).otherwise(0.0)).alias("e0"),
            F.sum(F.when(ev, F.col("_n")).otherwise(0)).alias("dcount")]
    for i, x in enumerate(xs):
        aggs += [F.sum(F.col(x) * w).alias(f"a1_{i}"), F.sum(F.when(ev, F.col(x) * w).otherwise(0.0)).alias(f"e1_{i}")]
        for j in range(i, p):
            xx = F.col(x) * F.col(xs[j]) * w
            aggs += [F.sum(xx).alias(f"a2_{i}_{j}"), F.sum(F.when(ev, xx).otherwise(0.0)).alias(f"e2_{i}_{j}")]
    per_t = d.groupBy(F.col(duration).alias("t")).agg(*aggs)
    # risk set = rows with duration >= t: running sums in descending time
    names = ["a0"] + [f"a1_{i}" for i in range(p)] + [f"a2_{i}_{j}" for i in range(p) for j in range(i, p)]
    chunk = F.lit(len(edges)) - range_chunk("t", edges)    # descending order of t
    rs = chunked_running(per_t.withColumn("_neg", -F.col("t")), [], [F.col("_neg")], chunk,
                         {f"r_{n}": F.col(n) for n in names}, n_chunks=len(edges) + 1).where(F.col("dcount") > 0)
    # Efron terms: one row per (time, l), l = 0..d-1, generated in blocks
    blocks = rs.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                                    F.ceil(F.col("dcount") / EFRON_BLOCK).cast("bigint") - 1))
                        .alias("_b"))
    blocks = blocks.repartition("t", "_b")
    terms = blocks.select("*", F.explode(F.sequence(F.col("_b") * EFRON_BLOCK,
                                                    F.least(F.col("dcount").cast("bigint"),
                                                            (F.col("_b") + 1) * EFRON_BLOCK) - 1))
                          .alias("_l"))
    phi = F.col("_l") / F.col("dcount")
    s0 = F.col("r_a0") - phi * F.col("e0")
    s1 = [F.col(f"r_a1_{i}") - phi * F.col(f"e1_{i}") for i in range(p)]
    out = [F.sum(F.log(s0)).alias("logs0")]
    out += [F.sum(s1[i] / s0).alias(f"g_{i}") for i in range(p)]
    for i in range(p):
        for j in range(i, p):
            s2 = F.col(f"r_a2_{i}_{j}") - phi * F.col(f"e2_{i}_{j}")
            out.append(F.sum(s2 / s0 - s1[i] * s1[j] / (s0 * s0)).alias(f"h_{i}_{j}"))
    tr = terms.agg(*out).first()
    ll = float(beta @ at_events) - (tr["logs0"] or 0.0)
    grad = np.array([at_events[i] - (tr[f"g_{i}"] or 0.0) for i in range(p)])
    hess = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            hess[i, j] = hess[j, i] = -(tr[f"h_{i}_{j}"] or 0.0)
    return ll, grad, hess


def cox_fit(df: DataFrame, covariates: Sequence[str], duration: str = "Duration", event: str = "Event",
            penalizer: float = 0.1, max_steps: int = 20, tol: float = 1e-9, chunks: int | None = None) -> dict:
    """Cox PH with Efron ties and an L2 penalty 0.5 * penalizer * ||b||^2 on standardised covariates.

    Returns coefficients on the original scale, standard errors, hazard ratios and the
    covariate means (for baseline curves). Rows with a null in any of the columns are left out.
    """
    from ..session import cut_lineage
    xs = list(covariates)
    df = df.where(functools.reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [duration, event, *xs]]))
    st = df.agg(*[F.avg(x).alias(f"m_{x}") for x in xs], *[F.stddev_samp(x).alias(f"s_{x}") for x in xs]).first()
    mean = np.array([st[f"m_{x}"] or 0.0 for x in xs])
    sd = np.array([st[f"s_{x}"] or 1.0 for x in xs])
    sd[sd == 0] = 1.0
    d = df.select(F.col(duration).cast("double").alias(duration), F.col(event).cast("int").alias(event),
                  *[((F.col(x) - F.lit(float(mean[i]))) / F.lit(float(sd[i]))).alias(x) for i, x in enumerate(xs)])
    # equal rows (time, event, covariates) collapse once; every step reads the collapsed table once
    d = cut_lineage(d.groupBy(duration, event, *xs).agg(F.count(F.lit(1)).alias("_n")))
    p = len(xs)
    sums = d.where(F.col(event) == 1).agg(F.count(F.lit(1)).alias("_e"), *[F.sum(F.col("_n") * F.col(x)).alias(f"x{i}") for i, x in enumerate(xs)]).first()
    at_events = np.array([sums[f"x{i}"] or 0.0 for i in range(p)])
    # durations do not change between Newton steps: chunk edges of the time axis once
    edges = range_edges(d.select(F.col(duration).alias("t")).distinct(), "t", chunks)

    def penalised(b):
        ll, g, h = _cox_step(d, xs, b, duration, event, edges, at_events)
        return ll - 0.5 * penalizer * float(b @ b), g - penalizer * b, h - penalizer * np.eye(p)

    beta = np.zeros(p)
    ll, g, h = penalised(beta)
    for _ in range(max_steps):
        direction = np.linalg.solve(-h, g)
        t = 1.0
        while True:   # step halving keeps the penalised likelihood from decreasing
            cand = beta + t * direction
            ll_c, g_c, h_c = penalised(cand)
            if ll_c >= ll - 1e-12 or t < 1e-3:
                break
            t /= 2
        beta, ll_old = cand, ll
        ll, g, h = ll_c, g_c, h_c
        if abs(ll - ll_old) < tol * max(1.0, abs(ll_old)) or np.max(np.abs(t * direction)) < 1e-10:
            break
    else:
        raise RuntimeError(f"no convergence in {max_steps} steps")
    h = h + penalizer * np.eye(p)
    cov = np.linalg.inv(-(h - penalizer * np.eye(p)))
    se_std = np.sqrt(np.diag(cov))
    coef = beta / sd
    se = se_std / sd
    return {"covariates": xs, "coef": coef.tolist(), "se": se.tolist(), "hazard_ratio": np.exp(coef).tolist(),
            "mean": mean.tolist(), "coef_std": beta.tolist()}


def cox_table(spark, fit: dict) -> DataFrame:
    rows = [(c, float(b), float(s), float(hr), float(b / s) if s > 0 else None)
            for c, b, s, hr in zip(fit["covariates"], fit["coef"], fit["se"], fit["hazard_ratio"])]
    return spark.createDataFrame(rows, "covariate string, coef double, se double, hazard_ratio double, z double")


def baseline_hazard(df: DataFrame, fit: dict, duration: str = "Duration", event: str = "Event",
                    chunks: int | None = None) -> DataFrame:
    """Breslow cumulative baseline hazard at centred covariates: (t, H0(t))."""
    xs = fit["covariates"]
    eta = sum(F.lit(float(b)) * (F.col(x) - F.lit(float(m))) for b, x, m in zip(fit["coef"], xs, fit["mean"]))
    per_t = df.groupBy(F.col(duration).cast("double").alias("t")).agg(
        F.sum(F.exp(eta)).alias("w"), F.count_if(F.col(event) == 1).alias("d"))
    edges = range_edges(per_t, "t", chunks)
    desc = chunked_running(per_t.withColumn("_neg", -F.col("t")), [], [F.col("_neg")],
                           F.lit(len(edges)) - range_chunk("t", edges), {"risk": F.col("w")},
                           n_chunks=len(edges) + 1)
    haz = desc.select("t", (F.col("d") / F.col("risk")).alias("dh"))
    asc = chunked_running(haz, [], [F.col("t")], range_chunk("t", edges), {"H0": F.col("dh")},
                          n_chunks=len(edges) + 1)
    return asc.select("t", "H0")


def survival_profiles(df: DataFrame, fit: dict, vary: str, values: Sequence[float],
                      duration: str = "Duration", event: str = "Event") -> DataFrame:
    """S(t | profile) = exp(-H0(t) exp((x - mean) b)) for profiles at the covariate means with
    ``vary`` set to each value; (value, t, survival)."""
    xs = fit["covariates"]
    h0 = baseline_hazard(df, fit, duration, event)
    lin = []
    for v in values:
        x = [float(v) if c == vary else m for c, m in zip(xs, fit["mean"])]
        lin.append((float(v), float(sum(b * (xi - m) for b, xi, m in zip(fit["coef"], x, fit["mean"])))))
    prof = F.array(*[F.struct(F.lit(v).alias("value"), F.lit(lp).alias("lp")) for v, lp in lin])
    return h0.select("t", "H0", F.inline(prof)).select(
        "value", "t", F.exp(-F.col("H0") * F.exp(F.col("lp"))).alias("survival"))


def exposure_curves(df: DataFrame, band: str, duration: str = "Duration", event: str = "Event",
                    horizon: float = 40.0, points: int = 41) -> DataFrame:
    """Exponential S(t) = exp(-lambda t) per band, lambda = events / person-time; (band, lambda, t, survival)."""
    lam = df.groupBy(band).agg((F.count_if(F.col(event) == 1) / F.sum(F.col(duration))).alias("hazard_rate"))
    step = horizon / (points - 1)
    g = lam.select(band, "hazard_rate", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("_i"))
    t = F.col("_i") * F.lit(step)
    return g.select(band, "hazard_rate", t.alias("t"), F.exp(-F.col("hazard_rate") * t).alias("survival"))


def cox_numpy(durations, events, X, penalizer: float = 0.1, iters: int = 50):
    """Brute-force Efron Cox on standardised X (tests only): returns coef on the original scale."""
    T = np.asarray(durations, float)
    E = np.asarray(events, int)
    X = np.asarray(X, float)
    mu, sd = X.mean(0), X.std(0, ddof=1)
    sd[sd == 0] = 1
    Z = (X - mu) / sd
    b = np.zeros(Z.shape[1])
    for _ in range(iters):
        ll, g, H = 0.0, np.zeros_like(b), np.zeros((len(b), len(b)))
        w = np.exp(Z @ b)
        for t in np.unique(T[E == 1]):
            risk = T >= t
            evs = (T == t) & (E == 1)
            dcount = evs.sum()
            a0, a1, a2 = w[risk].sum(), (Z[risk] * w[risk, None]).sum(0), (Z[risk].T * w[risk]) @ Z[risk]
            e0, e1, e2 = w[evs].sum(), (Z[evs] * w[evs, None]).sum(0), (Z[evs].T * w[evs]) @ Z[evs]
            ll += (Z[evs] @ b).sum()
            g += Z[evs].sum(0)
            for l in range(dcount):
                phi = l / dcount
                s0, s1, s2 = a0 - phi * e0, a1 - phi * e1, a2 - phi * e2
                ll -= math.log(s0)
                g -= s1 / s0
                H -= s2 / s0 - np.outer(s1, s1) / s0 ** 2
        g -= penalizer * b
        H -= penalizer * np.eye(len(b))
        step = np.linalg.solve(-H, g)
        b = b + step
        if np.abs(step).max() < 1e-12:
            break
    return b / sd
