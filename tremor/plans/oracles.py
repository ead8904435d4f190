"""DuckDB SQL of the catalogue.  ``_BASE`` holds the views that all queries share."""

from __future__ import annotations

from tremor.config import DETECTABLE_SIGNALS, INCIDENT_SIGNALS, METRIC_SUFFIXES, SYSTEM_NAMES
from tremor.operators.incidents import TOP_SERVICES
from tremor.plans.queries import GRID_MS, MOST_LAG, NAMES, ONE_DAY_MS, WINDOW_MS
from tremor.sources.adapters import WIDE


def _list(values) -> str:
    return ", ".join(f"'{x}'" for x in values)


def _service(c: str) -> str:
    whens = " ".join(f"when ends_with({c}, '_{s}') then left({c}, length({c}) - {len(s) + 1})" for s in METRIC_SUFFIXES)
    return rf"case {whens} else regexp_replace({c}, '_[^_]+\z', '') end"


def _signal(c: str) -> str:
    whens = " ".join(f"when ends_with({c}, '_{s}') then '{s}'" for s in METRIC_SUFFIXES)
    return rf"case {whens} else nullif(regexp_extract({c}, '([^_]+)\z', 1), '') end"


def _incident(c: str) -> str:
    return f"case {c} when 'cpu' then 'cpu_saturation' when 'delay' then 'db_latency' when 'loss' then 'network_failure' when 'socket' then 'network_failure' end"


_SECOND = "cast(1704067200 + (l_orderkey % 43200) * 60 + l_linenumber as bigint)"
_MAXES = ", ".join(f"max(case when metric_name = '{c}' then value end) as \"{c}\"" for c in WIDE)
_RESTRICTED = "case incident_type " + " ".join(f"when '{k}' then signal_type in ({_list(v)})" for k, v in INCIDENT_SIGNALS.items()) + " else true end"
_BASE = f"""
ground_truth as (
  select 'case_' || i as "case", 'DS-' || case i when 0 then 'OB' when 1 then 'SS' when 2 then 'TT' else 'OB' end as dataset,
    case i when 0 then 'cpu' when 1 then 'delay' when 2 then 'loss' else 'socket' end as fault, 'svc-' || (i % 2) as root_cause_service,
    cast(1705320000 + i * 3600 as bigint) as inject_time, cast(1705320000 + i * 3600 - 1209600 as bigint) as time_start, cast(1705320000 + i * 3600 + 1209600 as bigint) as time_end
  from (select cast(r_regionkey as bigint) as i from region where r_regionkey < 4) t),
cases as (select "case" as case_id, dataset, fault, root_cause_service, {_incident("fault")} as incident_type, inject_time * 1000 as inject_time_ms, time_start * 1000 as time_start_ms, time_end * 1000 as time_end_ms from ground_truth),
metrics_long as (
  select g."case", g.dataset, g.fault, g.root_cause_service, e.time, e.time * 1000 as timestamp, e.service || '_' || e.signal as metric_name, e.value
  from (select 'case_' || (user_id % 4) as c, 'svc-' || (cast(floor(user_id / 4) as bigint) % 2) as service,
    case event_type when 'click' then 'cpu' when 'view' then 'workload' when 'purchase' then 'latency-90' when 'error' then 'error' else 'socket' end as signal,
    cast(floor((epoch_us(ts) // 1000) / 1000) as bigint) as time, value from events) e join ground_truth g on g."case" = e.c),
metrics_wide as (select "case", dataset, fault, root_cause_service, time, {_MAXES} from metrics_long group by all),
logs_raw as (
  select g."case", g.dataset, g.fault, g.root_cause_service, cast(1704067200 + conv_id * 600 + turn as bigint) as timestamp, role as container_name, text as message
  from conversations c join ground_truth g on g."case" = 'case_' || (c.conv_id % 4)),
traces_raw as (
  select g."case", g.dataset, g.fault, g.root_cause_service, {_SECOND} as time, cast(l_orderkey as varchar) as "traceID", l_orderkey || '-' || l_linenumber as "spanID", 'svc-' || (l_suppkey % 7) as "serviceName",
    l_linestatus as "methodName", l_returnflag as "operationName", case when l_linenumber > 1 then l_orderkey || '-' || (l_linenumber - 1) end as "parentSpanID",
    {_SECOND} * 1000 as "startTimeMillis", {_SECOND} * 1000000 as "startTime", cast(l_quantity as double) as duration, case when l_returnflag = 'R' then 1.0::double else 0.0::double end as "statusCode"
  from lineitem l join ground_truth g on g."case" = 'case_' || (l.l_orderkey % 4)),
metric_events as (
  select 'metric:' || "case" || ':' || timestamp || ':' || metric_name as event_id, "case" as case_id, timestamp as timestamp_ms, dataset, fault, root_cause_service, 'metric' as source,
    {_service("metric_name")} as service_name, {_signal("metric_name")} as signal_type, metric_name, value, null::varchar as message, null::varchar as trace_id, null::varchar as span_id,
    null::varchar as parent_span_id, null::varchar as method_name, null::varchar as operation_name, null::double as duration_ms, null::double as status_code from metrics_long),
log_events as (
  select 'log:' || "case" || ':' || (timestamp * 1000) || ':' || (row_number() over (partition by "case" order by timestamp, container_name nulls first, message nulls first) - 1) as event_id,
    "case" as case_id, timestamp * 1000 as timestamp_ms, 'log' as source, container_name as service_name, message from logs_raw),
trace_events as (
  select 'trace:' || "case" || ':' || coalesce("spanID", 'unknown') || ':' || (row_number() over (partition by "case" order by "startTimeMillis", "spanID", "traceID", "serviceName", "methodName", "operationName", "parentSpanID" nulls first, duration, "statusCode") - 1) as event_id,
    "case" as case_id, "startTimeMillis" as timestamp_ms, 'trace' as source, "serviceName" as service_name, "traceID" as trace_id, "spanID" as span_id, "parentSpanID" as parent_span_id,
    "methodName" as method_name, "operationName" as operation_name, duration as duration_ms, "statusCode" as status_code from traces_raw),
all_events as (select * exclude (dataset, fault, root_cause_service) from metric_events union all by name select * from log_events union all by name select * from trace_events),
series as (
  select case_id, coalesce(nullif(service_name, ''), 'unknown') as service, signal_type, timestamp_ms, value, fault, root_cause_service, {_incident("fault")} as incident_type
  from metric_events where value is not null and isfinite(value) and signal_type in ({_list(DETECTABLE_SIGNALS)})),
marked as (select s.*, timestamp_ms < inject_time_ms as in_baseline from series s join cases c using (case_id)),
stats as (
  select case_id, service, signal_type, count(*) as n_total, count(*) filter (where in_baseline) as n_base, avg(value) filter (where in_baseline) as mean, stddev_pop(value) filter (where in_baseline) as std,
    max(value) filter (where in_baseline) as "max", quantile_cont(value, 0.95) filter (where in_baseline) as "quantile" from marked group by all),
scored as (
  select m.*, mean, std, "max", "quantile", case when std = 0 then 0.0 else (value - mean) / std end as score
  from marked m join (select * from stats where n_total >= 10 and n_base >= 10) s using (case_id, service, signal_type) where not in_baseline),
anomalies as (select * from scored where abs(score) >= 3.0),
judged as (select * from anomalies where {_RESTRICTED}),
halves as (select *, row_number() over (partition by case_id, service, signal_type order by timestamp_ms, value) <= floor(count(*) over (partition by case_id, service, signal_type) / 2) as in_baseline from series),
half_stats as (
  select case_id, service, signal_type, count(*) as n_total, count(*) filter (where in_baseline) as n_base, avg(value) filter (where in_baseline) as mean, stddev_pop(value) filter (where in_baseline) as std,
    max(value) filter (where in_baseline) as "max" from halves group by all),
half_anomalies as (
  select * from (select h.*, case when std = 0 then 0.0 else (value - mean) / std end as score
    from halves h join (select * from half_stats where n_total >= 10 and n_base >= 10) s using (case_id, service, signal_type)) z where abs(score) >= 3.0),
point_counts as (select case_id, count(*) as n from series group by case_id),
hits as (select c.*, a.timestamp_ms, a.service, a.case_id is not null as hit from cases c left join judged a using (case_id)),
validated as (
  select case_id, fault, incident_type, root_cause_service, count(*) filter (where timestamp_ms >= inject_time_ms) > 0 as detected, min(timestamp_ms) filter (where timestamp_ms >= inject_time_ms) as first_detection_ms,
    (min(timestamp_ms) filter (where timestamp_ms >= inject_time_ms) - inject_time_ms) / 1000.0::double as delay_seconds, count(*) filter (where timestamp_ms >= inject_time_ms) as valid_anomalies,
    count(*) filter (where hit) as total_anomalies, case when count(*) filter (where timestamp_ms >= inject_time_ms) > 0 then 'z_score' end as detection_method
  from hits group by case_id, fault, incident_type, root_cause_service, inject_time_ms),
counted as (
  select case_id, fault, incident_type, root_cause_service, inject_time_ms, time_start_ms, time_end_ms, count(*) filter (where timestamp_ms between inject_time_ms and time_end_ms) as true_positives,
    count(*) filter (where timestamp_ms >= time_start_ms and timestamp_ms < inject_time_ms) as false_positives, count(*) filter (where hit) as anomaly_count,
    min(timestamp_ms) filter (where timestamp_ms between inject_time_ms and time_end_ms) as first_detection_ms, coalesce(list_sort(list_distinct(list(service) filter (where service <> ''))), []) as services
  from hits group by case_id, fault, incident_type, root_cause_service, inject_time_ms, time_start_ms, time_end_ms),
by_binary as (select *, time_end_ms - inject_time_ms as total_faulty_points, inject_time_ms - time_start_ms as total_normal_points, case when true_positives > 0 then 1.0 else 0.0 end as recall from counted),
by_points as (
  select *, true_positives / total_faulty_points as recall from (
    select c.*, greatest(1, cast(floor(n * ((time_end_ms - inject_time_ms) / (time_end_ms - time_start_ms))) as bigint)) as total_faulty_points,
      greatest(1, cast(floor(n * ((inject_time_ms - time_start_ms) / (time_end_ms - time_start_ms))) as bigint)) as total_normal_points from counted c join point_counts using (case_id)) t)
"""


def _with(select: str, more: str = "") -> str:
    return f"with recursive {_BASE.strip()}{', ' + more if more else ''}\n{select}"


def _metrics(source: str) -> str:
    return f"""metrics as (
  select case_id, fault, incident_type, root_cause_service, true_positives > 0 as detected, (first_detection_ms - inject_time_ms) / 1000.0::double as delay_seconds, true_positives, false_positives,
    total_faulty_points, total_normal_points, cast(recall as double) as recall, precision, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0 end as f1_score,
    services, list_contains(services, root_cause_service) as root_cause_detected, first_detection_ms, case when true_positives > 0 then 'z_score' end as detection_method, anomaly_count
  from (select *, case when true_positives + false_positives > 0 then true_positives / (true_positives + false_positives) else 0.0 end as precision from {source}) p)"""


_CASE_SELECT = """select case_id, fault, incident_type, root_cause_service, detected, delay_seconds, true_positives, false_positives, total_faulty_points, total_normal_points, round(recall, 6) as recall,
  round(precision, 6) as precision, round(f1_score, 6) as f1_score, array_to_string(services, ',') as detected_services, root_cause_detected, first_detection_ms, detection_method, anomaly_count from metrics"""
_SHORT = "select case_id, service, signal_type, timestamp_ms, round(value, 6) as value, round(score, 6) as score, round({0}, 6) as threshold, incident_type from {1}"
_NAMES = f"names as (select unnest([{_list(NAMES)}]) as metric_name union all select distinct metric_name from metrics_long)"
_ODD = "odd as (select distinct event_type || '_' || (user_id % 7) || '_odd' as metric_name from events)"
_EDGES = """spans as (select * from traces_raw where "serviceName" is not null {0}),
parents as (select "case", "spanID" as pid, "serviceName" as source from spans qualify row_number() over (partition by "case", "spanID" order by time desc, "startTimeMillis" desc, "startTime" desc, "serviceName" desc,
  "parentSpanID" desc nulls last, "methodName" desc, "operationName" desc, duration desc, "statusCode" desc) = 1),
edges as (select distinct p.source, s."serviceName" as target from spans s join parents p on s."case" = p."case" and s."parentSpanID" = p.pid where p.source <> '' and p.source <> s."serviceName")"""
_BY = "count(*) as total, count(*) filter (where detected) as detected, cast(sum(false_positives) as bigint) as false_positives, round(avg(detected::int), 6) as detection_rate, round(avg(delay_seconds) filter (where detected), 6) as avg_delay_seconds"
_PROFILED = ("case", "spanID", "serviceName", "parentSpanID", "duration")
_SYSTEMS = " ".join(f"when '{k}' then '{v}'" for k, v in SYSTEM_NAMES.items())
_CHECKED = """select case_id, incident_type, {} from (select c.case_id, c.incident_type, count(*) filter (where timestamp_ms >= inject_time_ms) as after, count(*) filter (where timestamp_ms < inject_time_ms) as before,
  coalesce(string_agg(distinct a.incident_type, ',' order by a.incident_type) filter (where timestamp_ms >= inject_time_ms), '') as incident_types,
  coalesce(bool_or(a.incident_type = c.incident_type) filter (where timestamp_ms >= inject_time_ms), false) as own
  from cases c left join anomalies a on a.case_id = c.case_id group by all) t"""

_SESSIONS = f"""paused as (select *, abs(score) as strength, case when timestamp_ms - lag(timestamp_ms) over (partition by case_id, service order by timestamp_ms) <= {ONE_DAY_MS} then 0 else 1 end as opens from anomalies),
numbered as (select *, sum(opens) over (partition by case_id, service order by timestamp_ms rows unbounded preceding) as burst from paused),
named as (select *, case_id || '|' || service || '|' || min(timestamp_ms) over (partition by case_id, service, burst) as session from numbered),
bursts as (select case_id, service, session, min(timestamp_ms) as start_ms, max(timestamp_ms) as end_ms, count(*) as anomalies, max(strength) as peak from named group by case_id, service, session)"""
_INCIDENTS = _SESSIONS + ", " + _EDGES.format("") + """,
touching as (select a.session as u, b.session as v from bursts a join bursts b on a.case_id = b.case_id and a.start_ms <= b.end_ms and b.start_ms <= a.end_ms
  where exists (select 1 from edges e where (e.source = a.service and e.target = b.service) or (e.source = b.service and e.target = a.service))),
joined as (select session as s, session as r from bursts union select v, r from joined join touching on u = s),
members as (select b.*, incident_id from bursts b join (select s as session, min(r) as incident_id from joined group by s) j using (session))"""
_HOPS = _SESSIONS + ", " + _EDGES.format("") + f""",
hops as (select u.session as u, v.session as v from bursts u join bursts v on u.case_id = v.case_id and u.start_ms <= v.start_ms and v.start_ms <= u.end_ms + {ONE_DAY_MS} join edges e on e.target = u.service and e.source = v.service),
walks as (select b.case_id, b.service as origin, b.session, 0 as hops, b.service as path from bursts b join cases c on c.case_id = b.case_id and c.root_cause_service = b.service
  union all select w.case_id, w.origin, h.v, w.hops + 1, min(w.path || ' > ' || b.service) from walks w join hops h on h.u = w.session join bursts b on b.session = h.v where w.hops < (select count(*) from bursts) group by all)"""
_PRINTS = _INCIDENTS + """,
whole as (select case_id, incident_id, min(start_ms) as start_ms, sum(anomalies) as anomalies from members group by all),
by_signal as (select incident_id, signal_type, max(strength) as peak, min(timestamp_ms) as first_ms from named join members using (session) group by all),
by_service as (select incident_id, members.service, max(strength) as peak from named join members using (session) group by all),
high as (select incident_id, list(ln(1 + peak) order by peak desc) as high from by_service group by 1),
prints as (select w.case_id, w.incident_id as id, w.anomalies, [{}] || list_transform(range(1, {}), lambda k: coalesce(high[k], 0.0)) as v
  from whole w join high using (incident_id)),
queries as (select * from prints qualify row_number() over (partition by case_id order by anomalies desc, id desc) = 1)""".format(
    ", ".join(
        f"coalesce((select ln(1 + peak) from by_signal b where b.incident_id = w.incident_id and signal_type = '{x}'), 0.0), coalesce((select 1 / (1 + (b.first_ms - w.start_ms) / 3600000) from by_signal b where b.incident_id = w.incident_id and signal_type = '{x}'), 0.0)"
        for x in DETECTABLE_SIGNALS
    ),
    TOP_SERVICES + 1,
)
_NEAREST = """select query_id, id, round(similarity, 6) as similarity, cast(row_number() over (partition by query_id order by round(similarity, 9) desc, id) as integer) as place
from (select q.id as query_id, x.id, list_dot_product(q.v, x.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(x.v, x.v)) as similarity from queries q join {} x on x.id <> q.id) s qualify place <= {}"""

_TEMPLATES = r"""worded as (select row_number() over () as k, "case" as case_id, timestamp * 1000 as timestamp_ms,
  list_transform(regexp_split_to_array(trim(coalesce(message, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[ \t-\r]+'), lambda w: case when regexp_matches(w, '[0-9]') then '<*>' else w end) as w from logs_raw),
leaves as (select *, len(w) as n, w[1:2] as first, count(*) over (partition by len(w), w[1:2]) as size from worded),
common as (select n, first, i, word from (select n, first, size, unnest(range(1, n + 1)) as i, unnest(w) as word from leaves) x group by n, first, i, word, size having 2 * count(*) > size),
templated as (select l.case_id, l.timestamp_ms, string_agg(case when c.word = l.word then l.word else '<*>' end, ' ' order by l.i) as template
  from (select k, case_id, timestamp_ms, n, first, unnest(range(1, n + 1)) as i, unnest(w) as word from leaves) l left join common c using (n, first, i) group by l.k, l.case_id, l.timestamp_ms),
pivots as (select case_id, min(timestamp_ms) as lo, max(timestamp_ms) as hi, cast(floor((min(timestamp_ms) + max(timestamp_ms)) / 2) as bigint) as mid from worded group by 1),
counted_logs as (select case_id, template, lo, hi, mid, count(*) filter (where timestamp_ms < mid) as before, count(*) filter (where timestamp_ms >= mid) as after from templated join pivots using (case_id) group by all),
expected as (select *, (before + after) * (hi - mid + 1) / (hi - lo + 1) as e from counted_logs),
burst as (select *, 2 * (case when after > 0 then after * ln(after / e) else 0 end + case when before > 0 then before * ln(before / (before + after - e)) else 0 end) as g from expected)"""
_LAGS = f"""first_series as (select case_id, service, signal_type from (select case_id, service, signal_type, min(timestamp_ms) as first_ms from anomalies group by all) t qualify row_number() over (partition by case_id order by first_ms, service, signal_type) = 1),
cells as (select case_id, service, signal_type, cast(floor(timestamp_ms / {GRID_MS}) as bigint) as cell, avg(value) as value from series group by all),
refs as (select c.case_id, cell, value as ref, cast(unnest(range(-{MOST_LAG}, {MOST_LAG + 1})) as integer) as lag from cells c join first_series using (case_id, service, signal_type)),
lags as (select c.case_id, c.service, c.signal_type, lag, count(*) as n, corr(ref, value) as corr from cells c join refs r on r.case_id = c.case_id and c.cell = r.cell + r.lag group by all having count(*) >= 10 and stddev_pop(ref) > 0 and stddev_pop(value) > 0)"""

ORACLES = {
    "load_metrics_window": _with(f"""select "case", time, time * 1000 as timestamp, "svc-0_cpu", "svc-1_error" from metrics_wide where "case" = 'case_1' and time >= {WINDOW_MS[0] // 1000} and time <= {WINDOW_MS[1] // 1000}"""),
    "load_logs_window": _with("""select *, timestamp * 1000 as timestamp_ms from logs_raw where "case" = 'case_2' and timestamp between 1704067200 and 1704667200"""),
    "load_traces_window": _with("""select "case", "traceID", "spanID", "serviceName", "startTimeMillis", duration from traces_raw where "case" = 'case_0' and "startTimeMillis" between 1704067205000 and 1704367205000"""),
    "list_cases": _with('select distinct "case" from ground_truth'),
    "case_windows": _with("select * from cases"),
    "metric_columns": _with(" union all ".join(f"""select '{c}' as metric_name, count("{c}") as n from metrics_wide""" for c in WIDE)),
    "case_bundle_counts": _with("""select case_id, source, count(*) as n from (select 'metrics' as source, "case" as case_id, timestamp as ts from metrics_long union all select 'logs', "case", timestamp * 1000 from logs_raw
  union all select 'traces', "case", "startTimeMillis" from traces_raw) e join cases using (case_id) where ts between time_start_ms and time_end_ms group by all"""),
    "unpivot_metrics": _with(" union all ".join(f"""select "case", time * 1000 as timestamp, '{c}' as metric_name, "{c}" as value from metrics_wide""" for c in WIDE)),
    "crosstab_dataset_fault": _with("select dataset, " + ", ".join(f"count(*) filter (where fault = '{f}') as {f}" for f in ("cpu", "delay", "loss", "socket")) + " from metrics_long group by dataset"),
    "parse_service": _with(f"select metric_name, {_service('metric_name')} as service from names", _NAMES),
    "parse_signal": _with(f"select metric_name, {_signal('metric_name')} as signal from names", _NAMES),
    "parse_fallback": f"with {_ODD} select metric_name, {_service('metric_name')} as service, {_signal('metric_name')} as signal from odd",
    "metric_parseable": _with("select metric_name, contains(trim(metric_name), '_') as parseable from names", _NAMES),
    "normalize_metrics": _with("select * replace (round(value, 6) as value) from metric_events"),
    "normalize_logs": _with("select * from log_events"),
    "normalize_traces": _with("select * from trace_events"),
    "normalize_all": _with("select * replace (round(value, 6) as value) from all_events"),
    "events_by_source": _with("select source, count(*) as n, min(timestamp_ms) as first_ms, max(timestamp_ms) as last_ms from all_events group by source"),
    "build_series": _with("select * replace (round(value, 6) as value) from series"),
    "series_incident_restricted": _with(f"select case_id, service, signal_type, timestamp_ms, round(value, 6) as value from series where {_RESTRICTED}"),
    "series_bounds": _with("select case_id, service, signal_type, count(*) as n, min(timestamp_ms) as first_ms, max(timestamp_ms) as last_ms, round(min(value), 6) as low, round(max(value), 6) as high from series group by all"),
    "series_arrays": _with("select case_id, service, signal_type, string_agg(cast(timestamp_ms as varchar), ',' order by timestamp_ms) as timestamps, count(*) as n from series group by all"),
    "baseline_stats": _with("""select case_id, service, signal_type, n_total, n_base, round(mean, 6) as mean, round(std, 6) as std, round("max", 6) as "max" from stats"""),
    "baseline_quantile": _with("""select case_id, service, signal_type, round("quantile", 6) as "quantile" from stats"""),
    "baseline_eligible": _with("select case_id, service, signal_type, n_total, n_base from stats where n_total >= 10 and n_base >= 10"),
    "baseline_first_half": _with("""select case_id, service, signal_type, n_total, n_base, round(mean, 6) as mean, round(std, 6) as std, round("max", 6) as "max" from half_stats"""),
    "zscore_anomalies": _with(_SHORT.format("3.0::double", "anomalies")),
    "quantile_anomalies": _with(_SHORT.format('"quantile"', '(select * replace (value as score) from scored where value > "quantile") q')),
    "anomalies_min_value": _with(_SHORT.format("3.0::double", "anomalies where value >= 400.0")),
    "anomalies_no_baseline_end": _with(_SHORT.format("3.0::double", "half_anomalies")),
    "anomaly_event_ids": _with("select case_id || '|' || service || '|' || signal_type || '|' || timestamp_ms || '.0|z_score' as event_id, 'z_score' as method from anomalies"),
    "first_anomaly": _with("select case_id, timestamp_ms, service, signal_type, round(value, 6) as value from anomalies qualify row_number() over (partition by case_id order by timestamp_ms, service, signal_type, value) = 1"),
    "last_anomaly": _with("select case_id, timestamp_ms, service, signal_type, round(value, 6) as value from anomalies qualify row_number() over (partition by case_id order by timestamp_ms desc, service desc, signal_type desc, value desc) = 1"),
    "validate_detection": _with("select * from validated"),
    "validate_detection_windowed": _with(f"""select case_id, fault, incident_type, root_cause_service, valid > 0 as detected, first as first_detection_ms, (first - inject_time_ms) / 1000.0::double as delay_seconds, valid as valid_anomalies,
  total as total_anomalies, case when valid > 0 then 'z_score' end as detection_method from (select case_id, fault, incident_type, root_cause_service, inject_time_ms, count(*) filter (where hit) as total,
  count(*) filter (where timestamp_ms between inject_time_ms and inject_time_ms + {ONE_DAY_MS}) as valid, min(timestamp_ms) filter (where timestamp_ms between inject_time_ms and inject_time_ms + {ONE_DAY_MS}) as first
  from hits group by all) t"""),
    "detection_summary": _with("select count(*) as total_cases, count(*) filter (where detected) as detected_cases, round(avg(detected::int), 6) as detection_rate, round(avg(delay_seconds) filter (where detected), 6) as avg_delay_seconds from validated"),
    "detection_summary_by_incident": _with("select coalesce(incident_type, 'unknown') as incident_type, count(*) as total, count(*) filter (where detected) as detected, round(avg(detected::int), 6) as detection_rate from validated group by 1"),
    "case_metrics_binary": _with(_CASE_SELECT, _metrics("by_binary")),
    "case_metrics_points": _with(_CASE_SELECT, _metrics("by_points")),
    "aggregate_metrics": _with("""select total_cases, detected_cases, round(detection_rate, 6) as detection_rate, round(avg_recall, 6) as avg_recall, round(avg_precision, 6) as avg_precision, round(avg_f1_score, 6) as avg_f1_score,
  tp as total_true_positives, fp as total_false_positives, round(avg_delay_seconds, 6) as avg_delay_seconds, round(median_delay_seconds, 6) as median_delay_seconds, round(max_delay_seconds, 6) as max_delay_seconds,
  round(root_cause_detection_rate, 6) as root_cause_detection_rate, round(p, 6) as global_precision, round(r, 6) as global_recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end, 6) as global_f1_score
  from (select *, case when tp + fp > 0 then tp / (tp + fp) else 0.0 end as p, case when faulty > 0 then tp / faulty else 0.0 end as r
    from (select count(*) as total_cases, count(*) filter (where detected) as detected_cases, avg(detected::int) as detection_rate, avg(recall) as avg_recall, avg(precision) as avg_precision, avg(f1_score) as avg_f1_score,
      cast(sum(true_positives) as bigint) as tp, cast(sum(false_positives) as bigint) as fp, sum(total_faulty_points) as faulty, avg(delay_seconds) filter (where detected) as avg_delay_seconds,
      median(delay_seconds) filter (where detected) as median_delay_seconds, max(delay_seconds) filter (where detected) as max_delay_seconds, avg(root_cause_detected::int) as root_cause_detection_rate from metrics) a) b""", _metrics("by_points")),
    "delay_stats": _with("select round(avg(delay_seconds) filter (where detected), 6) as avg_delay_seconds, round(median(delay_seconds) filter (where detected), 6) as median_delay_seconds, round(max(delay_seconds) filter (where detected), 6) as max_delay_seconds from metrics", _metrics("by_binary")),
    "per_incident_metrics": _with(f"select coalesce(incident_type, 'unknown') as incident_type, {_BY}, round(avg(recall), 6) as avg_recall, round(avg(precision), 6) as avg_precision, round(avg(f1_score), 6) as avg_f1 from metrics group by 1", _metrics("by_binary")),
    "per_fault_metrics": _with(f"select fault, {_BY} from metrics group by fault", _metrics("by_binary")),
    "root_cause_hits": _with("select case_id, root_cause_service, root_cause_detected from metrics", _metrics("by_binary")),
    "before_after_counts": _with("select case_id, count(*) filter (where timestamp_ms < inject_time_ms) as before, count(*) filter (where timestamp_ms >= inject_time_ms) as after from cases left join half_anomalies using (case_id) group by case_id"),
    "scenario_check": _with(_CHECKED.format("after, before, incident_types, after > 0 and before = 0 and own as passed")),
    "scenario_acceptance": _with("select count(*) as cases, min(after) as min_after, max(before) as max_before, coalesce(min(after) > 0 and max(before) = 0, false) as accepted from (" + _CHECKED.format("after, before") + ") c"),
    "case_quality": _with("select case_id, case when inject_time_ms is null or time_start_ms is null or time_end_ms is null then 'a time is missing or no number' when time_start_ms > inject_time_ms or inject_time_ms > time_end_ms then 'the injection is outside of the case''s window' end as flaw from cases"),
    "anomalies_in_time_order": _with(f"select case_id, service, signal_type, timestamp_ms, round(value, 6) as value, round(score, 6) as score from anomalies where {_RESTRICTED} order by timestamp_ms, case_id, service, signal_type"),
    "value_counts_ordered": _with(" union all ".join(f"select '{k}' as ordered_by, cast(row_number() over (order by {o}) - 1 as integer) as place, fault, n from (select fault, count(*) as n from traces_raw group by fault) {k}_counts" for k, o in (("key", "fault"), ("desc", "n desc, fault"), ("asc", "n, fault")))),
    "first_cases": _with("""select distinct "case" from ground_truth where "case" is not null order by 1 limit 10"""),
    "incident_class_split": _with(f"""select {_incident("fault")} as incident_type, "case", fault from ground_truth"""),
    "ground_truth_semi": _with("""select "case", dataset, fault from ground_truth where "case" in (select "case" from logs_raw where container_name = 'user')"""),
    "telemetry_with_case": _with("""select "case", dataset, fault, root_cause_service, "spanID", "serviceName", duration from traces_raw"""),
    "cases_without_telemetry": _with("""select "case", fault from ground_truth where "case" not in (select "case" from logs_raw)"""),
    "union_heterogeneous": _with("""select "case", container_name, timestamp, null as "serviceName", null as time from logs_raw union all select "case", null, null, "serviceName", time from traces_raw"""),
    "services": _with("""select distinct "serviceName" as service from traces_raw where "serviceName" is not null"""),
    "dependencies": _with("select * from edges", _EDGES.format("")),
    "value_counts_dataset": _with("select dataset, count(*) as n from metrics_long group by 1"),
    "value_counts_fault": _with("select fault, count(*) as n from traces_raw group by 1"),
    "value_counts_root_cause": _with("select root_cause_service, count(*) as n from logs_raw group by 1"),
    "duplicate_rows": _with("""select cast(count(*) - (select count(*) from (select distinct "case", "traceID", "spanID", "serviceName" from traces_raw) d) as bigint) as duplicates from traces_raw"""),
    "null_counts": _with(" union all ".join(f"""select '{c}' as "column", count(*) - count("{c}") as nulls from metrics_wide""" for c in ("case", "dataset", "fault", "root_cause_service", "time", *WIDE))),
    "column_profile": _with(" union all ".join(f"""select '{c}' as "column", count("{c}") as non_null, count(distinct "{c}") as "distinct" from traces_raw""" for c in _PROFILED)),
    "top_root_causes": _with("select metric_name, count(*) as n from metrics_long group by 1 order by n desc, metric_name limit 5"),
    "system_name_counts": _with(f"select case regexp_extract(dataset, '-(OB|SS|TT)$', 1) {_SYSTEMS} end as system_name, count(*) as n from metrics_long group by 1"),
    "inject_time_datetime": _with("""select "case", strftime(make_timestamp(inject_time * 1000000), '%Y-%m-%d %H:%M:%S') as injected_at from ground_truth"""),
    "topology_counts": _with("select source, count(*) as n_targets from edges group by 1", _EDGES.format("")),
    "reachable_services": _with("select source, target, min(hops) as hops from reach group by all", _EDGES.format("") + ", reach as (select source, target, 1 as hops from edges union select r.source, e.target, r.hops + 1 from reach r join edges e on e.source = r.target where r.hops <= (select count(*) from (select source from edges union select target from edges) s))"),
    "first_deviation": _with("select *, cast(row_number() over (partition by case_id order by first_ms, service, signal_type) as integer) as place from (select case_id, service, signal_type, min(timestamp_ms) as first_ms from anomalies group by all) t"),
    "similar_vectors": """with v as (select vec_id as id, cast(embedding as double[]) as v from embeddings), u as (select id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as n from v),
s as (select q.id as query_id, u.id, case when q.n * u.n > 0 then list_dot_product(q.v, u.v) / (q.n * u.n) else 0.0 end as similarity from u q join u on u.id <> q.id where q.id % 50 = 0)
select query_id, id, round(similarity, 6) as similarity, cast(row_number() over (partition by query_id order by round(similarity, 9) desc, id) as integer) as place from s qualify place <= 5""",
    "logs_near_incident": _with(f"select event_id, case_id, timestamp_ms, service_name from log_events join cases using (case_id) where timestamp_ms between inject_time_ms - {15 * ONE_DAY_MS} and inject_time_ms + {ONE_DAY_MS}"),
    "anomaly_sessions": _with("select * replace (round(peak, 6) as peak) from bursts", _SESSIONS),
    "incident_sessions": _with("select case_id, incident_id, min(start_ms) as start_ms, max(end_ms) as end_ms, arg_min(service, struct_pack(a := start_ms, b := service)) as first_service, string_agg(distinct service, ',' order by service) as services, count(*) as sessions, cast(sum(anomalies) as bigint) as anomalies, round(max(peak), 6) as peak_score from members group by case_id, incident_id", _INCIDENTS),
    "impact_paths": _with("select case_id, origin, service, start_ms as arrival_ms, hops, path from walks join bursts using (case_id, session) where service <> origin qualify row_number() over (partition by case_id, origin, service order by start_ms, hops, path) = 1", _HOPS),
    "similar_incidents": _with(_NEAREST.format("prints", 3), _PRINTS),
    "similar_vectors_indexed": "with x as (select cast(vec_id as varchar) as id, vec_id, cast(embedding as double[]) as v from embeddings), queries as (select * from x where vec_id % 50 = 0) " + _NEAREST.format("x", 5),
    "relevant_logs": _with("select case_id, template, before, after, round(score, 6) as score, cast(row_number() over (partition by case_id order by score desc, template) as integer) as place from (select *, round(case when after >= e then g else -g end, 9) as score from burst) b", _TEMPLATES),
    "lead_lag": _with("select case_id, service, signal_type, lag, n, round(corr, 6) as corr, cast(row_number() over (partition by case_id, service, signal_type order by abs(round(corr, 9)) desc, abs(lag), lag) as integer) as place from lags", _LAGS),
    "stored_points": _with("""select resource, day, count(*) as n, round(max(value), 6) as high from (select case_id, metric_name, timestamp_ms, coalesce(nullif(service_name, ''), 'unknown') as resource,
  strftime(make_timestamp(timestamp_ms * 1000), '%Y-%m-%d') as day, max(value) as value from metric_events group by all) t group by all"""),
    "incident_nodes": _with("select case_id, service, incident_type, min(timestamp_ms) as first_ms, max(timestamp_ms) as last_ms, count(*) as anomalies, round(max(abs(score)), 6) as peak_score from anomalies group by all"),
}
