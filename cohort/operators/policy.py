"""Decision-log analytics: action values, inverse-propensity policy value, intervention ROI.

A decision log is (action, reward[, propensity][, order]). All estimates are single
grouped aggregates; the running value per action uses chunked running sums, so a
dominant action does not put its whole history into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import chunked_running, join_small, range_chunk, range_edges


def action_values(log: DataFrame, action: str = "action", reward: str = "reward") -> DataFrame:
    """(action, n, value = mean reward, is_greedy); greedy = best value, ties -> smallest action."""
    g = log.groupBy(action).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(reward).cast("double")).alias("value"))
    best = Window.orderBy(F.desc("value"), F.asc(action))   # one row per action
    return g.withColumn("is_greedy", F.row_number().over(best) == 1)


def greedy_action(log: DataFrame, action: str = "action", reward: str = "reward"):
    return action_values(log, action, reward).where("is_greedy").select(action).first()[0]


def running_action_values(log: DataFrame, order: str, action: str = "action", reward: str = "reward",
                          chunks: int | None = None) -> DataFrame:
    """Incremental mean per action in ``order`` (the epsilon-greedy value estimate after each pull)."""
    edges = range_edges(log, order, chunks)
    d = chunked_running(log, [action], [F.col(order)], range_chunk(order, edges),
                        {"_s": F.col(reward).cast("double"), "_n": F.lit(1)})
    return d.withColumn("running_value", F.col("_s") / F.col("_n")).withColumnRenamed("_n", "pulls").drop("_s")


def empirical_propensity(log: DataFrame, action: str = "action", name: str = "propensity") -> DataFrame:
    """Propensity = share of the logged action (when the log does not carry one)."""
    shares = log.groupBy(action).agg(F.count(F.lit(1)).alias("_c"))
    total = F.sum("_c").over(Window.partitionBy())   # over the small per-action table
    shares = shares.select(action, (F.col("_c") / total).alias(name))
    return join_small(log, shares, action)   # one row per action; AQE broadcasts it after measuring


def ips_value(log: DataFrame, target_action, action: str = "action", reward: str = "reward",
              propensity: str = "propensity") -> DataFrame:
    """(logged_value, ips_value, uplift_pct) for the policy that always picks ``target_action``.

    IPS = mean(1[a = target] * r / p); uplift = (ips - logged) / logged * 100.
    """
    r = F.col(reward).cast("double")
    w = F.when(F.col(action) == F.lit(target_action), r / F.col(propensity)).otherwise(F.lit(0.0))
    g = log.agg(F.avg(r).alias("logged_value"), F.avg(w).alias("ips_value"))
    return g.withColumn("uplift_pct", F.try_divide((F.col("ips_value") - F.col("logged_value")) * 100.0,
                                                   F.col("logged_value")))


def ips_value_column(log: DataFrame, target_col: str, action: str = "action", reward: str = "reward",
                     propensity: str = "propensity") -> DataFrame:
    """IPS for a per-row target policy given as a column."""
    r = F.col(reward).cast("double")
    w = F.when(F.col(action) == F.col(target_col), r / F.col(propensity)).otherwise(F.lit(0.0))
    g = log.agg(F.avg(r).alias("logged_value"), F.avg(w).alias("ips_value"))
    return g.withColumn("uplift_pct", F.try_divide((F.col("ips_value") - F.col("logged_value")) * 100.0,
                                                   F.col("logged_value")))


def intervention_roi(kpi: DataFrame, target_col: str = "at_risk", cost_per: float = 500.0,
                     success_rate: float = 0.40, value_per: float = 20000.0, recall: float = 1.0) -> DataFrame:
    """ROI columns on a KPI row: cost, retained, value saved, net, ratio (0 when cost is 0)."""
    t = F.col(target_col).cast("double")
    cost = t * F.lit(cost_per)
    retained = t * F.lit(recall) * F.lit(success_rate)
    saved = retained * F.lit(value_per)
    return kpi.select(F.col(target_col).alias("targeted"), cost.alias("cost"), retained.alias("retained"),
                      saved.alias("value_saved"), (saved - cost).alias("net"),
                      F.coalesce(F.try_divide(saved, cost), F.lit(0.0)).alias("roi_ratio"))
