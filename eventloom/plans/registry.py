"""All queries over event logs, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..log import click_log, variants
from ..operators import compare, dfg, filters, ocel, org, relations, sequences, stats, timing

JAN = 1_704_067_200_000_000
LOW, HIGH = JAN + 5 * 86_400_000_000, JAN + 20 * 86_400_000_000

LOG = "with log as (select user_id case_id, event_type activity, epoch_us(ts) us, event_id event_idx, 'R' || (cast(json_extract_string(props, '$.k') as bigint) % 10) resource, value as cost from events where user_id is not null and event_type is not null and ts is not null), seq as (select *, lead(activity) over w nxt, (lead(us) over w - us) / 1e6 gap, lead(activity, 2) over w nxt2, lag(activity) over w prv, lead(resource) over w nres, row_number() over w pos from log window w as (partition by case_id order by us, event_idx)), cases as (select case_id, count(*) n_events, min(us) s, max(us) e from log group by 1), tr as (select case_id, string_agg(activity, ',' order by us, event_idx) variant from log group by 1) "
SIZES = LOG + "select case_id, count(*) n_events from log where {} group by 1"
REL = "with rel as (select 'p' || o_orderkey eid, 'place' activity, epoch_us(o_orderdate) us, unnest(['o' || o_orderkey, 'c' || o_custkey]) oid, unnest(['order', 'customer']) otype from orders union all select 's' || l_orderkey || '-' || l_linenumber, 'ship', epoch_us(l_shipdate), unnest(['o' || l_orderkey, 'i' || l_partkey, 'u' || l_suppkey]), unnest(['order', 'part', 'supplier']) from lineitem) "
PER = LOG + ", pc as (select case_id, activity, min((us, event_idx)) f, max((us, event_idx)) l, count(*) n from log group by 1, 2), ac as (select distinct activity b from log), pr as (select x.case_id, x.activity a, ac.b, x.f fa, x.l la, x.n na, y.f fb, y.l lb, y.n nb from pc x join ac on ac.b <> x.activity left join pc y on y.case_id = x.case_id and y.activity = ac.b) "
VS = "(select variant, count(*) n from tr group by 1)"
WITH = {}


def add(name: str, run, sql: str | None) -> None:
    WITH[name] = (run, sql)


def on_log(f):
    return lambda spark, d: f(click_log(spark, d))


def sized(f):
    return lambda spark, d: filters.summary(f(click_log(spark, d)))


def on_objects(f):
    return lambda spark, d: f(ocel.order_relations(spark, d))


def in_cases(where: str) -> str:
    return SIZES.format(f"case_id in (select case_id from {where})")


add("dfg_frequency", on_log(dfg.frequency), LOG + "select activity source, nxt target, count(*) frequency from seq where nxt is not null group by 1, 2")
add("dfg_window2", on_log(lambda l: dfg.frequency(l, 2)), LOG + "select activity source, nxt2 target, count(*) frequency from seq where nxt2 is not null group by 1, 2")
add("dfg_once_per_case", on_log(dfg.once_per_case), LOG + "select activity source, nxt target, count(distinct case_id) cases from seq where nxt is not null group by 1, 2")
add("dfg_performance", on_log(dfg.performance), LOG + ", g as (select activity source, nxt target, lead(us) over (partition by case_id order by us, event_idx) - us g from seq), t as (select source, target, count(*) n, cast(sum(g) as double) s, cast(sum(cast(g as hugeint) * g) as double) q, quantile_cont(g, 0.5) / 1e6 median_s, min(g) / 1e6 min_s, max(g) / 1e6 max_s from g where target is not null group by 1, 2) select source, target, s / n / 1e6 mean_s, median_s, min_s, max_s, s / 1e6 sum_s, case when n > 1 then round(sqrt(greatest((q - s * s / n) / (n - 1), 0)) / 1e6, 3) end stdev_s from t")
add("dfg_cost", on_log(dfg.cost), LOG + "select activity source, nxt target, round(sum(cost), 4) as cost from seq where nxt is not null group by 1, 2")
add("dfg_noise_filtered", on_log(dfg.noise_filtered), LOG + ", f as (select activity source, nxt target, count(*) frequency from seq where nxt is not null group by 1, 2), m as (select act, max(frequency) most from (select source act, frequency from f union all select target, frequency from f) group by 1) select source, target, frequency from f join m x on x.act = source join m y on y.act = target where frequency >= 0.2 * least(x.most, y.most)")
add("freq_triples", on_log(dfg.triples), LOG + "select activity a, nxt b, nxt2 c, count(*) n from seq where nxt2 is not null group by 1, 2, 3")
add("eventually_follows", on_log(dfg.eventually_follows), LOG + "select x.activity source, y.activity target, count(*) frequency from seq x join seq y on x.case_id = y.case_id and x.pos < y.pos group by 1, 2")
EDGES = LOG + ", f as (select activity s, nxt t, count(*) n from seq where nxt is not null group by 1, 2) "
add("causal_heuristic", on_log(dfg.dependency), EDGES + ", p as (select s, t from f union select t, s from f) select p.s source, p.t target, round((coalesce(f.n, 0) - coalesce(g.n, 0)) / (coalesce(f.n, 0) + coalesce(g.n, 0) + 1), 6) dependency from p left join f on f.s = p.s and f.t = p.t left join f g on g.s = p.t and g.t = p.s")
add("heuristics_net_dependency", on_log(dfg.heuristics_dependency), EDGES + "select f.s source, f.t target, round(case when f.s = f.t then f.n / (f.n + 1) else (f.n - coalesce(g.n, 0)) / (f.n + coalesce(g.n, 0) + 1) end, 6) dependency from f left join f g on g.s = f.t and g.t = f.s")
add("footprints", on_log(dfg.footprints), LOG + ", f as (select distinct activity source, nxt target from seq where nxt is not null) select source, target, case when exists (select 1 from f g where g.source = f.target and g.target = f.source) then '||' else '->' end relation from f")
add("min_self_distance", on_log(dfg.min_self_distance), LOG + "select activity, min(d) distance from (select activity, lead(pos) over (partition by case_id, activity order by pos) - pos - 1 d from seq) where d is not null group by 1")
add("start_activities", on_log(stats.endpoints), LOG + "select activity, count(*) n from seq where prv is null group by 1")
add("end_activities", on_log(lambda l: stats.endpoints(l, True)), LOG + "select activity, count(*) n from seq where nxt is null group by 1")
add("attribute_values", on_log(lambda l: stats.attribute_values(l, "resource")), LOG + "select resource as value, count(*) n from log where resource is not null group by 1")
add("attribute_values_once_per_case", on_log(lambda l: stats.attribute_values(l, "activity", True)), LOG + "select activity as value, count(distinct case_id) n from log group by 1")
for unit, part in {"hour": "hour", "weekday": "isodow", "day": "day", "week": "week", "month": "month", "year": "year"}.items():
    low, high = stats.UNITS.get(unit, ("(select year(min(ts)) from events)", "(select year(max(ts)) from events)"))
    x = f"cast(extract({part} from make_timestamp(us)) as bigint){' - 1' if unit == 'weekday' else ''}"
    add(f"events_distribution_{unit}", on_log(lambda l, u=unit: stats.distribution(l, u)), LOG + f"select k as {unit}, cast(sum(n) as bigint) n from (select {x} k, 1 n from log union all select unnest(generate_series({low}, {high})), 0) group by 1")
add("case_durations", on_log(stats.case_durations), LOG + "select case_id, round((e - s) / 1e6, 4) duration_s from cases")
add("case_size", on_log(filters.summary), LOG + "select case_id, n_events from cases")
add("case_arrival_average", on_log(stats.arrival_average), LOG + "select round((max(s) - min(s)) / 1e6 / (count(*) - 1), 4) average_s from cases")
add("case_dispersion_average", on_log(lambda l: stats.arrival_average(l, True)), LOG + "select round((max(e) - min(e)) / 1e6 / (count(*) - 1), 4) average_s from cases")
add("arrival_rate", on_log(stats.gaps), LOG + "select case_id, round(coalesce((s - lag(s) over (order by s, case_id)) / 1e6, 0), 4) gap_s from cases")
add("finish_rate", on_log(lambda l: stats.gaps(l, True)), LOG + "select case_id, round(coalesce((e - lag(e) over (order by e, case_id)) / 1e6, 0), 4) gap_s from cases")
add("case_overlap", on_log(stats.case_overlap), LOG + "select x.case_id, count(*) as overlap from cases x join cases y on y.e >= x.s and y.s <= x.e group by 1")
add("rework_per_activity", on_log(stats.rework_per_activity), LOG + "select activity, count(*) n from (select case_id, activity from log group by 1, 2 having count(*) > 1) group by 1")
add("rework_per_case", on_log(stats.rework_per_case), LOG + "select case_id, count(*) - count(distinct activity) rework from log group by 1")
add("variants", on_log(variants), LOG + "select variant, count(*) n from tr group by 1")
add("variants_top_k", on_log(lambda l: stats.top_variants(l, 20)), LOG + f"select * from {VS} order by n desc, variant desc limit 20")
add("variant_durations", on_log(stats.variant_durations), LOG + "select variant, count(*) n, round(avg((e - s) / 1e6), 4) mean_s from tr join cases using (case_id) group by 1")
add("stochastic_language", on_log(stats.stochastic_language), LOG + f"select variant, round(n / (select count(*) from cases), 8) p from {VS}")
add("activity_positions", on_log(stats.activity_positions), LOG + "select activity, pos - 1 as position, count(*) n from seq group by 1, 2")
add("filter_start", sized(lambda l: filters.start(l, ["view", "click"])), in_cases("seq where prv is null and activity in ('view', 'click')"))
add("filter_end", sized(lambda l: filters.end(l, ["purchase"], False)), SIZES.format("case_id not in (select case_id from seq where nxt is null and activity = 'purchase')"))
add("filter_attr_events", sized(lambda l: filters.events(l, "resource", ["R1", "R2"])), SIZES.format("resource in ('R1', 'R2')"))
add("filter_attr_events_negative", sized(lambda l: filters.events(l, "resource", ["R1", "R2"], False)), SIZES.format("(resource is null or resource not in ('R1', 'R2'))"))
add("filter_attr_cases", sized(lambda l: filters.attribute_cases(l, "activity", ["purchase"])), in_cases("log where activity = 'purchase'"))
add("filter_numeric", sized(lambda l: filters.numeric_events(l, "cost", 10, 60)), SIZES.format("cost between 10 and 60"))
add("filter_relative_occurrence", sized(lambda l: filters.relative_occurrence(l, "resource", ["R1", "R2"], 0.2)), in_cases("log group by case_id having avg(case when resource in ('R1', 'R2') then 1.0 else 0.0 end) >= 0.2"))
add("filter_variants_top_k", sized(lambda l: filters.variants_top_k(l, 20)), in_cases(f"tr where variant in (select variant from {VS} order by n desc, variant desc limit 20)"))
add("filter_df_relation", sized(lambda l: filters.follows(l, "view", "purchase")), in_cases("seq where activity = 'view' and nxt = 'purchase'"))
add("filter_path_performance", sized(lambda l: filters.path_performance(l, "view", "click", 0, 86_400)), in_cases("seq where activity = 'view' and nxt = 'click' and gap between 0 and 86400"))
add("filter_time_events", sized(lambda l: filters.time_events(l, LOW, HIGH)), SIZES.format(f"us between {LOW} and {HIGH}"))
add("filter_time_intersecting", sized(lambda l: filters.time_intersecting(l, LOW, HIGH)), in_cases(f"cases where (s > {LOW} and s < {HIGH}) or (e > {LOW} and e < {HIGH}) or (s < {LOW} and e > {HIGH})"))
add("filter_case_size", sized(lambda l: filters.case_size(l, 50, 70)), in_cases("cases where n_events between 50 and 70"))
add("filter_case_performance", sized(lambda l: filters.case_performance(l, 0, 2_500_000)), in_cases("cases where (e - s) / 1e6 between 0 and 2500000"))
add("filter_rework", sized(lambda l: filters.rework(l, "purchase", 12)), in_cases("log where activity = 'purchase' group by case_id having count(*) >= 12"))
add("filter_prefix", sized(lambda l: filters.prefix(l, "purchase")), LOG + "select case_id, count(*) n_events from seq where pos < (select min(pos) from seq q where q.case_id = seq.case_id and q.activity = 'purchase') group by 1")
add("filter_suffix", sized(lambda l: filters.suffix(l, "purchase")), LOG + "select case_id, count(*) n_events from seq where pos > (select max(pos) from seq q where q.case_id = seq.case_id and q.activity = 'purchase') group by 1")
add("filter_starts_with", sized(lambda l: filters.starts_with(l, ["view", "click"])), in_cases("seq where pos = 1 and activity = 'view' and nxt = 'click'"))
add("filter_four_eyes", sized(lambda l: filters.four_eyes(l, "view", "purchase")), SIZES.format("case_id not in (select x.case_id from log x join (select case_id, arg_max(resource, (us, event_idx)) rb from log where activity = 'purchase' group by 1) y using (case_id) where x.activity = 'view' and x.resource = y.rb)"))
add("filter_between", on_log(lambda l: filters.between(l, "view", "purchase")), LOG + ", m as (select case_id, pos, activity, max(case when activity = 'purchase' then pos end) over (partition by case_id order by pos rows between unbounded preceding and 1 preceding) lastb from seq where activity in ('view', 'purchase')), o as (select case_id, coalesce(lastb, 0) seg, min(pos) i from m where activity = 'view' group by 1, 2), c as (select case_id, coalesce(lastb, 0) seg, min(pos) j from m where activity = 'purchase' group by 1, 2) select case_id, row_number() over (partition by case_id order by i) - 1 sub_case, j - i + 1 n_events from o join c using (case_id, seg) where i < j")
add("consecutive_collapse", sized(filters.collapse), LOG + "select case_id, count(*) n_events from seq where prv is null or prv <> activity group by 1")
add("handover", on_log(org.handover), LOG + "select resource source, nres target, count(*) n, round(count(*) / sum(count(*)) over (), 8) weight from seq where resource is not null and nres is not null group by 1, 2")
add("working_together", on_log(org.working_together), LOG + ", r as (select distinct case_id, resource from log where resource is not null) select x.resource a, y.resource b, count(*) cases from r x join r y on x.case_id = y.case_id and x.resource < y.resource group by 1, 2")
add("activity_resource_map", on_log(org.activity_resource), LOG + "select activity, resource, count(*) n from log where resource is not null group by 1, 2")
add("resource_similarity", on_log(org.similar_activities), LOG + ", m as (select activity, resource, count(*) n from log where resource is not null group by 1, 2), g as (select r.resource, a.activity, coalesce(m.n, 0) n from (select distinct resource from m) r cross join (select distinct activity from m) a left join m on m.resource = r.resource and m.activity = a.activity) select x.resource a, y.resource b, round(corr(x.n, y.n), 6) similarity from g x join g y on x.activity = y.activity and x.resource < y.resource group by 1, 2")
add("resource_profile", on_log(org.profile), LOG + "select resource, count(*) as events, count(distinct activity) activities, count(distinct case_id) cases, count(distinct us // 86400000000) as days from log where resource is not null group by 1")
add("log_skeleton", on_log(relations.skeleton), PER + "select a, b, count(*) cases, count(*) filter (na = nb) equivalence, count(*) filter (la < lb) always_after, count(*) filter (fb < fa) always_before, count(*) filter (nb is null) never_together from pr group by 1, 2")
add("declare_support", on_log(relations.declare), PER + "select a, b, count(*) filter (la < lb) response, count(*) filter (fa < fb) as precedence, count(*) filter (la < lb and fa < fb) succession, count(*) filter (nb is not null) coexistence from pr group by 1, 2")
LATER = LOG + ", g as (select x.activity a, y.activity b, y.us - x.us g from seq x join seq y on x.case_id = y.case_id and x.pos < y.pos), t as (select a, b, count(*) n, cast(sum(g) as double) s, cast(sum(cast(g as hugeint) * g) as double) q from g group by 1, 2), tp as (select a, b, s / n / 1e6 mean_s, case when n > 1 then round(sqrt(greatest((q - s * s / n) / (n - 1), 0)) / 1e6, 3) else 0 end std_s from t) "
add("temporal_profile", on_log(relations.temporal_profile), LATER + "select * from tp")
add("temporal_deviations", on_log(lambda l: relations.temporal_deviations(l, relations.temporal_profile(l))), LATER + "select a, b, count(*) deviations from g join tp using (a, b) where abs(g / 1e6 - mean_s) > 2 * std_s group by 1, 2")
add("prediction_targets", on_log(relations.targets), LOG + "select case_id, event_idx, activity, nxt next_activity, round(gap, 6) next_s, round((max(us) over (partition by case_id) - us) / 1e6, 6) remaining_s from seq")
add("transition_system", on_log(relations.prefix_states), LOG + ", x as (select activity, prv, lag(activity, 2) over (partition by case_id order by us, event_idx) prv2 from seq) select concat_ws(',', prv2, prv) state, activity, concat_ws(',', prv, activity) next_state, count(*) n from x group by 1, 2, 3")
MARKED = LOG.replace("with log as (select", "with log as (select case when user_id % 2 = 0 then 'original' else 'simulated' end lg,")
TWO = "count(*) filter (lg = 'original') as original, count(*) filter (lg = 'simulated') simulated"
on_two = lambda f: on_log(lambda l: f(compare.split(l)))
add("compare_activities", on_two(compare.activities), MARKED + f"select activity, {TWO} from log group by 1")
add("compare_edges", on_two(compare.edges), MARKED + f"select activity source, nxt target, {TWO} from seq where nxt is not null group by 1, 2")
add("compare_variants", on_two(compare.variants), LOG + f"select variant, {TWO} from (select variant, case when case_id % 2 = 0 then 'original' else 'simulated' end lg from tr) group by 1")
add("compare_durations", on_two(compare.durations), LOG + "select case when case_id % 2 = 0 then 'original' else 'simulated' end log, count(*) cases, round(avg(d), 4) mean_s, round(stddev_samp(d), 4) std_s, round(quantile_cont(d, 0.25), 4) p25_s, round(quantile_cont(d, 0.5), 4) median_s, round(quantile_cont(d, 0.75), 4) p75_s, round(max(d), 4) max_s from (select case_id, (e - s) / 1e6 d from cases) group by 1")
add("ocel_flatten_order", on_objects(lambda r: filters.summary(ocel.flatten(r, "order"))), REL + "select oid case_id, count(*) n_events from rel where otype = 'order' group by 1")
add("ocdfg", on_objects(ocel.ocdfg), REL + ", p as (select *, lead(activity) over w target, lead(eid) over w nx from rel window w as (partition by otype, oid order by us, eid)) select otype, activity source, target, count(distinct (eid, nx)) event_couples, count(distinct oid) unique_objects, count(*) total_objects from p where target is not null group by 1, 2, 3")
add("ocel_object_summary", on_objects(ocel.object_summary), REL + "select otype, count(*) objects, min(n) fewest, max(n) most from (select otype, oid, count(*) n from rel group by 1, 2) group by 1")
add("ocel_type_activities", on_objects(ocel.type_activities), REL + "select otype, activity, count(distinct eid) as events, count(distinct oid) objects from rel group by 1, 2")
add("ocel_objects_per_event", on_objects(ocel.objects_per_event), REL + "select activity, otype, min(n) fewest, max(n) most from (select eid, activity, otype, count(*) n from rel group by 1, 2, 3) group by 1, 2")

DAY = 86_400_000_000
IVL = LOG + ", ivl as (select *, us a, us + cast(round(cost) as bigint) * 1000000 z from log) "
SLOTS = f"sum(case when (d + 3) % 7 < 5 then greatest(0, least({{1}}, d * {DAY} + 17 * 3600000000) - greatest({{0}}, d * {DAY} + 7 * 3600000000)) else 0 end) / 1e6"
DAYS = f"unnest(generate_series({{0}} // {DAY}, {{1}} // {DAY})) d"
on_intervals = lambda f: on_log(lambda l: f(timing.intervals(l, F.col("cost"))))
add("case_durations_business", on_log(timing.business_durations), LOG + f"select case_id, round({SLOTS.format('s', 'e')}, 4) business_s from (select *, {DAYS.format('s', 'e')} from cases) group by 1")
add("dfg_performance_business", on_log(timing.business_performance), LOG + f", p as (select activity source, nxt target, case_id, pos, us t, lead(us) over (partition by case_id order by us, event_idx) u from seq), g as (select source, target, case_id, pos, {SLOTS.format('t', 'u')} b from (select *, {DAYS.format('t', 'u')} from p where target is not null) group by 1, 2, 3, 4) select source, target, round(avg(b), 4) mean_s, round(sum(b), 4) sum_s from g group by 1, 2")
add("service_time", on_intervals(timing.service_time), IVL + "select activity, round(avg((z - a) / 1e6), 4) mean_s, round(quantile_cont((z - a) / 1e6, 0.5), 4) median_s, round(min((z - a) / 1e6), 4) min_s, round(max((z - a) / 1e6), 4) max_s, round(sum((z - a) / 1e6), 4) sum_s from ivl group by 1")
add("service_waiting", on_intervals(timing.service_waiting), IVL + "select case_id, round(sum(z - a) / 1e6, 4) service_s, round((max(z) - min(a)) / 1e6, 4) sojourn_s, round((max(z) - min(a) - sum(z - a)) / 1e6, 4) waiting_s from ivl group by 1")
add("cycle_time", on_intervals(timing.cycle_time), IVL + ", m as (select a, z, max(z) over (order by a, z rows between unbounded preceding and 1 preceding) p from ivl), b as (select a, z, sum(case when p is null or a > p then 1 else 0 end) over (order by a, z rows unbounded preceding) k from m), k as (select k, min(a) a, max(z) z from b group by 1) select round(coalesce(sum(z - a), 0) / 1e6 / (select count(distinct case_id) from log), 4) cycle_s from k where k < (select max(k) from k)")
add("compare_activity_durations", on_log(timing.compare_activity_durations), LOG + "select case when case_id % 2 = 0 then 'original' else 'simulated' end log, activity, round(avg(gap / 3600), 4) mean_h, round(quantile_cont(gap / 3600, 0.5), 4) median_h, round(quantile_cont(gap / 3600, 0.9), 4) p90_h from seq where nxt is not null group by 1, 2")
add("prefixes_first_5", sized(lambda l: sequences.first_events(l, 5)), LOG + "select case_id, count(*) n_events from seq where pos <= 5 group by 1")
add("activity_first_position", on_log(sequences.positions), LOG + "select case_id, activity, min(pos) - 1 as position from seq group by 1, 2")
add("training_samples", on_log(lambda l: sequences.samples(l, 3)), LOG + "select case_id, event_idx, concat_ws(',', coalesce(lag(activity, 3) over w, '<pad>'), coalesce(lag(activity, 2) over w, '<pad>'), prv) prefix, activity next_activity from seq window w as (partition by case_id order by pos) qualify prv is not null")
add("performance_spectrum", on_log(lambda l: sequences.spectrum(l, ["view", "click", "purchase"])), LOG + ", f as (select case_id, activity x, lead(activity) over w y, lead(activity, 2) over w z, us t0, lead(us) over w t1, lead(us, 2) over w t2 from log where activity in ('view', 'click', 'purchase') window w as (partition by case_id order by us, event_idx)) select case_id, t0, t1, t2 from f where x = 'view' and y = 'click' and z = 'purchase'")
add("filter_trace_segments", sized(lambda l: sequences.trace_segments(l, [["...", "view", "click", "purchase", "..."]])), in_cases("seq where activity = 'view' and nxt = 'click' and nxt2 = 'purchase'"))
add("filter_trace_segments_negative", sized(lambda l: sequences.trace_segments(l, [["view", "..."], ["...", "purchase"]], False)), SIZES.format("case_id not in (select case_id from seq where (prv is null and activity = 'view') or (nxt is null and activity = 'purchase'))"))
add("declare_unary", on_log(relations.declare_unary), LOG + ", c as (select case_id, activity, count(*) n, bool_or(prv is null) f from seq group by 1, 2) select activity, count(*) existence, (select count(*) from cases) - count(*) absence, count(*) filter (n = 1) exactly_one, count(*) filter (f) init from c group by 1")
add("declare_alternate", on_log(relations.declare_alternate), PER + "select a, b, count(*) filter (na = nb and la < lb) alternate_response, count(*) filter (na = nb and fa < fb) alternate_precedence, count(*) filter (na = nb and la < lb and fa < fb) alternate_succession from pr group by 1, 2")


def queries() -> dict:
    from . import cases, more  # noqa: F401  they register their queries

    return {k: run for k, (run, _) in WITH.items()}


def oracle_sql() -> dict:
    from . import cases, more  # noqa: F401

    return {k: sql for k, (_, sql) in WITH.items() if sql}
