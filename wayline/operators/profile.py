"""All statistics of short series in one wide row: variability of every feature and path geometry of every feature space.

One window orders a series (an author's years), one aggregate reduces it; nothing is unpivoted or joined on the way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.operators.geometry import METRICS, REST


def wide_profile(df: DataFrame, keys: list[str], order: list[str], features: list[str], spaces: dict[str, list[str]], stats: list[str]) -> DataFrame:
    """keys, ``<feature>_<stat>`` and ``<space>_<metric>``: what ``series.variability`` and ``geometry.path_metrics`` give.

    ``stats``: among variance, cv, rmssd, masd, rmssd_norm, masd_norm. NULL values are skipped by the statistics; a step whose
    ends are not both known is no step of a path. Series are of bounded length.
    """
    by, at = ", ".join(keys), ", ".join(f"{c} ASC NULLS LAST" for c in order)
    last = ", ".join(f"{c} IS NULL, {c}" for c in order)
    over, before = f"OVER (PARTITION BY {by} ORDER BY {at})", f"OVER (PARTITION BY {by} ORDER BY {at} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    used = sorted({f for cols in spaces.values() for f in cols} | set(features))
    rows = df.selectExpr(*keys, *order, *(f"CAST({f} AS DOUBLE) AS {f}" for f in used))
    rows = rows.selectExpr("*", *(f"{f} - lag({f}) {over} AS _s_{f}" for f in used), *(f"{f} - last({f}, true) {before} AS _d_{f}" for f in features))
    square = lambda cols, mark="": " + ".join(f"{mark}{c} * {mark}{c}" for c in cols)
    # Distances below rounding noise count as none, as in geometry.
    rest = lambda distance, size: f"CASE WHEN {distance} <= {REST} * sqrt({size}) THEN 0.0D ELSE {distance} END"
    rows = rows.selectExpr("*", *(f"{rest(f'sqrt({square(cols, "_s_")})', square(cols))} AS _l_{s}" for s, cols in spaces.items()))
    rows = rows.selectExpr("*", *("(" + " + ".join(f"_s_{c} * lag(_s_{c}) {over}" for c in cols) + f") / nullif(_l_{s} * lag(_l_{s}) {over}, 0.0D) AS _c_{s}" for s, cols in spaces.items()))
    sums = ["count(*) AS _n"]
    for f in features:
        sums += [f"avg({f}) AS _avg_{f}", f"var_samp({f}) AS _var_{f}", f"avg(_d_{f} * _d_{f}) AS _sq_{f}", f"avg(abs(_d_{f})) AS _abs_{f}"]
    sums += [f"min_by(struct({', '.join(used)}), struct({last})) AS _a", f"max_by(struct({', '.join(used)}), struct({last})) AS _z"]
    for s in spaces:
        sums += [f"avg(_l_{s}) AS _mean_{s}", f"stddev_pop(_l_{s}) AS _std_{s}", f"sum(_l_{s}) AS _sum_{s}", f"avg(_c_{s}) AS _cos_{s}"]
    g = rows.groupBy(*keys).agg(*map(F.expr, sums))
    out, nets = [], []
    for f in features:
        known = {"variance": f"_var_{f}", "cv": f"sqrt(_var_{f}) / nullif(abs(_avg_{f}), 0.0D)", "rmssd": f"sqrt(_sq_{f})", "masd": f"_abs_{f}",
                 "rmssd_norm": f"sqrt(_sq_{f}) / nullif(abs(_avg_{f}), 0.0D)", "masd_norm": f"_abs_{f} / nullif(abs(_avg_{f}), 0.0D)"}
        out += [f"{known[name]} AS {f}_{name}" for name in stats]
    for s, cols in spaces.items():
        net = f"sqrt({' + '.join(f'(_a.{c} - _z.{c}) * (_a.{c} - _z.{c})' for c in cols)})"
        nets.append(f"CASE WHEN _n >= 2 THEN {rest(net, square(cols, '_z.'))} END AS _net_{s}")
        tortuosity = f"CASE WHEN _net_{s} > 0 THEN _sum_{s} / _net_{s} WHEN _net_{s} = 0 THEN 1.0D END"
        known = [f"_mean_{s}", f"_std_{s}", f"_net_{s}", f"_sum_{s}", tortuosity, f"_cos_{s}"]
        out += [f"{c} AS {s}_{m}" for m, c in zip(METRICS, known)]
    return g.selectExpr("*", *nets).selectExpr(*keys, *out)
