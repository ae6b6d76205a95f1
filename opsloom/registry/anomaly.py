"""Baseline, z-score, rolling and isolation-forest queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.operators import anomaly, iforest
from opsloom.plans.durable import durable
from opsloom.registry import Views, query, rounded

METRICS = anomaly.METRICS
VERDICT = "metric_name is_anomaly confidence severity observed_value baseline_mean z_score".split()

BASE_SQL = "base as (select service_name, " + ", ".join(
    f"avg({m}) as {m}_mean, case when stddev_pop({m}) = 0 then 1.0 else stddev_pop({m}) end as {m}_std"
    for m in METRICS
) + " from {telemetry} where event_type_is_known group by service_name)"
BASE_SQL = BASE_SQL.replace(" where event_type_is_known", "")


def verdict_sql(metric: str, rank: int, source: str) -> str:
    return f"""select seq, {rank} as rank, '{metric}' as metric_name,
      abs(z) > 3 as is_anomaly, least(1.0, round(abs(z) / 6.0, 2)) as confidence,
      case when abs(z) >= 4.5 then 'CRITICAL' when abs(z) > 3 then 'WARNING' else 'NORMAL' end as severity,
      round({metric}, 2) as observed_value, round({metric}_mean, 2) as baseline_mean, round(z, 2) as z_score
    from (select *, ({metric} - {metric}_mean) / {metric}_std as z from {source})"""


SCORED_SQL = (
    f"with {BASE_SQL}, joined as (select t.*, b.* exclude (service_name) from {{telemetry}} t join base b using (service_name)), "
    "scored as (" + " union all ".join(verdict_sql(m, i, "joined") for i, m in enumerate(METRICS)) + ")"
)


def _scored(v: Views):
    return anomaly.zscore_score(v.telemetry, anomaly.baseline_stats(v.telemetry))


@query(
    "baseline_stats",
    f"with {BASE_SQL} select service_name, "
    + ", ".join(f"round({m}_{s}, 4) as {m}_{s}" for m in METRICS for s in ("mean", "std"))
    + " from base",
)
def baseline_stats(v: Views):
    stats = anomaly.baseline_stats(v.telemetry)
    return stats.select(
        "service_name",
        *[F.round(f"{m}_{s}", 4).alias(f"{m}_{s}") for m in METRICS for s in ("mean", "std")],
    )


@query("zscore_score", SCORED_SQL + " select * exclude (rank) from scored")
def zscore_score(v: Views):
    return _scored(v).select("seq", F.inline("scores")).select("seq", *VERDICT)


@query(
    "worst_metric",
    SCORED_SQL + """ select * exclude (rank) from scored
    qualify row_number() over (partition by seq order by abs(z_score) desc, rank) = 1""",
)
def worst_metric(v: Views):
    rows = _scored(v).select("seq", anomaly.worst_metric(F.col("scores")).alias("w"))
    return rows.select("seq", *[F.col(f"w.{c}").alias(c) for c in VERDICT])


# Recursion over arrival order: one step handles one event of every service, the window of
# accepted samples travels as three lists.
ROLLING_SQL = """with recursive ordered as (
  select service_name, seq, cpu_percent as c, memory_percent as m, latency_ms as l,
    row_number() over (partition by service_name order by seq) as pos from {telemetry}),
steps as (
  select service_name, pos, seq, 'WARMING_UP' as status, [c] as cs, [m] as ms, [l] as ls,
    null::double as zc, null::double as zm, null::double as zl, null::double as mc, null::double as mm,
    null::double as ml, c, m, l
  from ordered where pos = 1
  union all
  select service_name, pos, seq, status,
    case when keep then list_append(cs, c)[-500:] else cs end,
    case when keep then list_append(ms, m)[-500:] else ms end,
    case when keep then list_append(ls, l)[-500:] else ls end,
    zc, zm, zl, mc, mm, ml, c, m, l
  from (
    select *, status = 'WARMING_UP' or not (abs(case when abs(round(zc, 2)) >= abs(round(zm, 2)) and abs(round(zc, 2)) >= abs(round(zl, 2)) then zc
        when abs(round(zm, 2)) >= abs(round(zl, 2)) then zm else zl end) > 3) as keep
    from (
      select *, case when scored then (c - mc) / sc end as zc, case when scored then (m - mm) / sm end as zm,
        case when scored then (l - ml) / sl end as zl
      from (
        select o.service_name, o.pos, o.seq, o.c, o.m, o.l, s.cs, s.ms, s.ls,
          len(s.cs) >= 20 as scored, case when len(s.cs) >= 20 then 'SCORED' else 'WARMING_UP' end as status,
          case when len(s.cs) >= 20 then list_avg(s.cs) end as mc,
          case when len(s.cs) >= 20 then list_avg(s.ms) end as mm,
          case when len(s.cs) >= 20 then list_avg(s.ls) end as ml,
          coalesce(nullif(list_stddev_pop(s.cs), 0), 1) as sc,
          coalesce(nullif(list_stddev_pop(s.ms), 0), 1) as sm,
          coalesce(nullif(list_stddev_pop(s.ls), 0), 1) as sl
        from steps s join ordered o on o.service_name = s.service_name and o.pos = s.pos + 1)))),
worst as (
  select *, case when abs(round(zc, 2)) >= abs(round(zm, 2)) and abs(round(zc, 2)) >= abs(round(zl, 2)) then 'cpu_percent'
    when abs(round(zm, 2)) >= abs(round(zl, 2)) then 'memory_percent'
    when zl is not null then 'latency_ms' end as metric_name from steps),
rolled as (
  select service_name, seq, status, len(cs)::int as baseline_events, metric_name,
    abs(z) > 3 as is_anomaly, case when z is not null then least(1.0, cast(round(cast(abs(z) / 6.0 as decimal(28, 9)), 2) as double)) end as confidence,
    case when abs(z) >= 4.5 then 'CRITICAL' when abs(z) > 3 then 'WARNING' when z is not null then 'NORMAL' end as severity,
    case metric_name when 'cpu_percent' then cast(round(cast(c as decimal(28, 9)), 2) as double) when 'memory_percent' then cast(round(cast(m as decimal(28, 9)), 2) as double)
      when 'latency_ms' then cast(round(cast(l as decimal(28, 9)), 2) as double) end as observed_value,
    case metric_name when 'cpu_percent' then cast(round(cast(mc as decimal(28, 9)), 2) as double) when 'memory_percent' then cast(round(cast(mm as decimal(28, 9)), 2) as double)
      when 'latency_ms' then cast(round(cast(ml as decimal(28, 9)), 2) as double) end as baseline_mean,
    cast(round(cast(zc as decimal(28, 9)), 2) as double) as z_cpu_percent, cast(round(cast(zm as decimal(28, 9)), 2) as double) as z_memory_percent, cast(round(cast(zl as decimal(28, 9)), 2) as double) as z_latency_ms
  from (select *, case metric_name when 'cpu_percent' then zc when 'memory_percent' then zm else zl end as z from worst))"""


@query("rolling_baseline_ingest", ROLLING_SQL + " select * from rolled")
def rolling_baseline_ingest(v: Views):
    return anomaly.rolling_ingest(v.telemetry)


@query("rolling_baseline_ingest_split", ROLLING_SQL + " select * from rolled")
def rolling_baseline_ingest_split(v: Views):
    """The form a hot service takes, forced with short folds."""
    return anomaly.rolling_ingest(v.telemetry, split=True, fold_rows=250)


@query(
    "anomaly_counts",
    ROLLING_SQL + """ select 'Z_SCORE' as detector_type, severity, count(*) as anomalies
    from rolled where is_anomaly group by severity""",
)
def anomaly_counts(v: Views):
    return anomaly.anomaly_counts(anomaly.rolling_ingest(v.telemetry))


WINDOWED_SQL = (
    "with stats as (select *, "
    + ", ".join(
        f"avg({m}) over w as {m}_mean, coalesce(nullif(stddev_pop({m}) over w, 0), 1) as {m}_std"
        for m in METRICS
    )
    + """, count(*) over w as n from {telemetry}
    window w as (partition by service_name order by seq rows between 500 preceding and 1 preceding))
    select seq, case when n >= 20 then 'SCORED' else 'WARMING_UP' end as status, n as baseline_events, """
    + ", ".join(
        f"case when n >= 20 then round(({m} - {m}_mean) / {m}_std, 2) else 0 end as z_{m}"
        for m in METRICS
    )
    + ", "
    + ", ".join(
        f"n >= 20 and abs(({m} - {m}_mean) / {m}_std) > 3 as anomalous_{m}" for m in METRICS
    )
    + " from stats"
)


def _windowed(v: Views, **kwargs):
    rows = anomaly.rolling_zscore(v.telemetry, **kwargs)
    return rows.select(
        "seq",
        "status",
        "baseline_events",
        *[F.col("scores")[i]["z_score"].alias(f"z_{m}") for i, m in enumerate(METRICS)],
        *[F.col("scores")[i]["is_anomaly"].alias(f"anomalous_{m}") for i, m in enumerate(METRICS)],
    )


@query("rolling_zscore_window", WINDOWED_SQL)
def rolling_zscore_window(v: Views):
    return _windowed(v)


@query("rolling_zscore_window_split", WINDOWED_SQL)
def rolling_zscore_window_split(v: Views):
    """The form a hot service takes, forced with short blocks."""
    return _windowed(v, split=True, block_rows=700)


@query(
    "detectors_fired",
    SCORED_SQL + """ select seq, coalesce(string_agg('zscore:' || metric_name, ',' order by
        case metric_name when 'latency_ms' then 0 when 'cpu_percent' then 1 else 2 end)
        filter (where is_anomaly), '') as fired, bool_or(is_anomaly) as detected
    from scored group by seq""",
)
def detectors_fired(v: Views):
    fired = _scored(v).select("seq", anomaly.detectors_fired(F.col("scores")).alias("f"))
    return fired.select("seq", F.array_join("f", ",").alias("fired"), (F.size("f") > 0).alias("detected"))


def _average_path_sql(n: str) -> str:
    return f"case when {n} <= 1 then 0e0 when {n} = 2 then 1e0 else 2e0 * (ln({n} - 1e0) + 0.5772156649e0) - 2e0 * ({n} - 1e0) / {n} end"


def _draw_sql(first: int) -> str:
    return f"('0x' || substr(md5('42|' || tree || '|' || node), {first}, 8))::bigint"


# 100 trees of 256 rows each, 42 as seed; level by level, every row goes left or right.
FOREST_SQL = f"""with recursive pool as (
  select seq, cpu_percent as f0, memory_percent as f1, latency_ms as f2, md5('forest|42|' || seq) as d,
    count(*) over () as total from {{telemetry}}),
drawn as (
  select *, ('0x' || substr(d, 1, 8))::bigint % 2147483647 as a, ('0x' || substr(d, 9, 8))::bigint % 2147483646 + 1 as b from pool),
placed as (
  select tree, seq, f0, f1, f2, total, (a + tree * b) % 2147483647 as place from drawn, range(100) as t(tree)),
sample as (
  select * from placed
  where total <= 1024 or place < cast(floor(2147483647 * (1024e0 / total)) as bigint)
  qualify row_number() over (partition by tree order by place, seq) <= 256),
grown as (
  select tree, 0::bigint as node, 0 as depth, f0, f1, f2, ceil(log2(greatest(2, count(*) over (partition by tree)))) as deepest from sample
  union all
  select tree, 2 * node + case when case feature when 0 then f0 when 1 then f1 else f2 end
      <= case when threshold >= high then low else threshold end then 1 else 2 end, depth + 1, f0, f1, f2, deepest
  from (select *, low + (high - low) * part as threshold from (
    select *, [lo0, lo1, lo2][feature + 1] as low, [hi0, hi1, hi2][feature + 1] as high from (
      select *, spread[choice % len(spread) + 1] as feature from (
        select *, list_filter([0, 1, 2], lambda x: [lo0 < hi0, lo1 < hi1, lo2 < hi2][x + 1]) as spread,
          {_draw_sql(1)} as choice, {_draw_sql(9)} / 4294967296e0 as part
        from (select *, min(f0) over w as lo0, max(f0) over w as hi0, min(f1) over w as lo1, max(f1) over w as hi1,
            min(f2) over w as lo2, max(f2) over w as hi2 from grown where depth < deepest window w as (partition by tree, node)))
      where len(spread) > 0)))),
ranges as (
  select tree, node, any_value(depth) as depth, count(*) as n, any_value(deepest) as deepest, min(f0) as lo0, max(f0) as hi0,
    min(f1) as lo1, max(f1) as hi1, min(f2) as lo2, max(f2) as hi2 from grown group by tree, node),
split as (
  select *, list_filter([0, 1, 2], lambda x: [lo0 < hi0, lo1 < hi1, lo2 < hi2][x + 1] and depth < deepest) as spread,
    {_draw_sql(1)} as choice, {_draw_sql(9)} / 4294967296e0 as part from ranges),
chosen as (
  select *, case when len(spread) > 0 then spread[choice % len(spread) + 1] else -1 end as feature from split),
nodes as (
  select tree, node, feature, case when low + (high - low) * part >= high then low else low + (high - low) * part end as threshold,
    case when feature < 0 then depth + {_average_path_sql("n")} else 0e0 end as path
  from (select *, [lo0, lo1, lo2][feature + 1] as low, [hi0, hi1, hi2][feature + 1] as high from chosen)),
walked as (
  select service_name, seq, tree, 0::bigint as node, cpu_percent as f0, memory_percent as f1, latency_ms as f2
  from {{telemetry}}, range(100) as t(tree)
  union all
  select service_name, seq, w.tree, 2 * w.node + case when case feature when 0 then f0 when 1 then f1 else f2 end <= threshold then 1 else 2 end,
    f0, f1, f2
  from walked w join nodes n on n.tree = w.tree and n.node = w.node where n.feature >= 0),
depths as (
  select service_name, seq, sum(path) / 100 as path from walked w join nodes n on n.tree = w.tree and n.node = w.node and n.feature < 0 group by all),
scores as (
  select service_name, seq, round(-pow(2e0, -path / ({_average_path_sql("256e0")})), 9) as score from depths),
forest as (
  select *, score < (select quantile_cont(score, 0.05) from scores) as is_anomaly from scores)"""


@query("iforest_fit", FOREST_SQL + """ select tree::int as tree, count(*) as nodes, round(max(path), 4) as deepest
    from nodes group by tree""")
def iforest_fit(v: Views):
    nodes = iforest.fit_nodes(v.telemetry)
    return nodes.groupBy("tree").agg(
        F.count(F.lit(1)).alias("nodes"), F.round(F.max("path"), 4).alias("deepest")
    )


def _forest(v: Views):
    events = v.telemetry.select("service_name", "seq", *METRICS)
    # Written once: the offset and the verdicts both read it.
    scored = durable(iforest.score_samples(events, iforest.fit_nodes(events)))
    return iforest.forest_verdicts(scored, iforest.training_offset(scored))


def forest_flagged(v: Views):
    return _forest(v).select("service_name", "seq", *METRICS, F.col("is_anomaly").alias("forest_flag"))


@query(
    "iforest_score",
    FOREST_SQL + f""" select service_name, seq, 'multivariate_telemetry' as metric_name, is_anomaly,
      {rounded("-score", 2)} as confidence, case when not is_anomaly then 'NORMAL' when score < -0.65 then 'CRITICAL'
        else 'WARNING' end as severity, {rounded("score", 4)} as anomaly_score from forest""",
)
def iforest_score(v: Views):
    return _forest(v).drop(*METRICS)


@query(
    "detectors_fired_forest",
    FOREST_SQL + ", " + SCORED_SQL.removeprefix("with ") + """, names as (
      select seq, 'zscore:' || metric_name as name,
        case metric_name when 'latency_ms' then 0 when 'cpu_percent' then 1 else 2 end as pos from scored where is_anomaly
      union all select seq, 'isolation_forest', 3 from forest where is_anomaly)
    select seq, coalesce(string_agg(name, ',' order by pos), '') as fired, count(name) > 0 as detected
    from {telemetry} left join names using (seq) group by seq""",
)
def detectors_fired_forest(v: Views):
    """All detectors together: the z-scores and the forest."""
    forest = forest_flagged(v)
    scored = anomaly.zscore_score(forest, anomaly.baseline_stats(forest))
    fired = scored.select("seq", anomaly.detectors_fired(F.col("scores"), F.col("forest_flag")).alias("f"))
    return fired.select("seq", F.array_join("f", ",").alias("fired"), (F.size("f") > 0).alias("detected"))
