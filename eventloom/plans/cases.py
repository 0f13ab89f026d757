"""Queries with added events and columns, rules and their violations, batches and process trees; each with its SQL where SQL can say it."""

from __future__ import annotations

from ..operators import columns, dfg, filters, nets, relations, timing, trees
from .more import ORDERS, SIZE, on_orders, sized
from .registry import IVL, LOG, PER, add, on_intervals, on_log

HASH = "('0x' || substr(md5('0:' || case_id), 1, 8))::bigint / 4294967296.0"
OPR = ORDERS + PER[len(LOG) :]

# events and columns
add("artificial_ends_dfg", on_orders(lambda l: dfg.frequency(columns.artificial_ends(l))), ORDERS + ", x as (select case_id, activity, us, event_idx from log union all select case_id, '▶', s - 1000, null from cases union all select case_id, '■', e + 1000, null from cases), y as (select activity source, lead(activity) over (partition by case_id order by us, event_idx) target from x) select source, target, count(*) frequency from y where target is not null group by 1, 2")
add("event_positions", on_log(lambda l: columns.numbered(l).select("case_id", "event_idx", "position")), LOG + "select case_id, event_idx, pos - 1 as position from seq")
add("classified_dfg", on_orders(lambda l: dfg.frequency(columns.classified(l, "activity", "resource"))), ORDERS + ", x as (select activity || '+' || resource source, lead(activity || '+' || resource) over (partition by case_id order by us, event_idx) target from log where resource is not null) select source, target, count(*) frequency from x where target is not null group by 1, 2")
add("activity_alphabet", on_orders(columns.alphabet), ORDERS + "select activity, chr(cast(64 + row_number() over (order by activity) as int)) letter from (select distinct activity from log)")
add("split_train", sized(lambda l: columns.split(l)[0]), SIZE.format(f"{HASH} < 0.8"))
add("split_test", sized(lambda l: columns.split(l)[1]), SIZE.format(f"{HASH} >= 0.8"))
add("sample_cases", sized(lambda l: columns.sample_cases(l, 100)), SIZE.format(f"case_id in (select case_id from cases order by {HASH}, case_id limit 100)"))
add("lifted_resource", on_orders(lambda l: columns.lifted(l, "resource")), ORDERS + "select case_id, min(resource) resource from log group by 1 having min(resource) = max(resource) and count(resource) = count(*)")
add("lifecycle_events", on_intervals(lambda l: columns.lifecycle(l).select("case_id", "event_idx", "transition", "us")), IVL + "select case_id, event_idx, 'start' as transition, a us from ivl union all select case_id, event_idx, 'complete', z from ivl")
add("passed_time", on_log(lambda l: columns.passed(l).select("case_id", "event_idx", "since_s", "until_s")), LOG + "select case_id, event_idx, (us - s) / 1e6 since_s, (e - us) / 1e6 until_s from log join cases using (case_id)")
add("case_lengths_between", sized(lambda l: filters.case_size(l, 2, 3)), SIZE.format("case_id in (select case_id from cases where n_events between 2 and 3)"))
# relations
STEPS = ", st as (select case_id, activity a, nxt b, count(*) d from seq where nxt <> activity group by all) "
add("chain_relations", on_orders(relations.chains), OPR + STEPS + "select pr.a, pr.b, count(*) cases, count(*) filter (d = na) directly_follows, count(*) filter (d = na and d = nb) chain from pr left join st on st.case_id = pr.case_id and st.a = pr.a and st.b = pr.b group by all")
add("declare_negative", on_orders(relations.declare_negative), OPR + STEPS + "select pr.a, pr.b, count(*) filter (nb is null) noncoexistence, count(*) filter ((la < lb and fa < fb) is not true) nonsuccession, count(*) filter ((d = na and d = nb) is not true) nonchainsuccession from pr left join st on st.case_id = pr.case_id and st.a = pr.a and st.b = pr.b group by all")
add("case_features", on_orders(relations.features), ORDERS + "select case_id, count(*) filter (activity = 'place') n_place, count(*) filter (activity = 'ship A') \"n_ship A\", count(*) filter (activity = 'ship N') \"n_ship N\", count(*) filter (activity = 'ship R') \"n_ship R\", count(*) n_events, round((max(us) - min(us)) / 1e6, 4) duration_s, round(avg(cost), 6) mean_cost from log group by 1")
add("activity_occurrences", on_orders(relations.occurrences), ORDERS + ", k as (select activity, coalesce(n, 0) n from (select distinct activity from log) cross join cases left join (select case_id, activity, count(*) n from log group by all) using (case_id, activity)) select activity, n, count(*) cases from k group by all")
HELD = " union all ".join(f"select {{0}}a, b, '{r}' as rule, {e} ok from pr" for r, e in relations.RULES.items())
RULE = f"ru as (select a, b, rule from ({HELD.format('')}) group by all having count(*) filter (ok) >= {{}} * count(*))"
add("skeleton_rules", on_orders(lambda l: relations.rules(l, 0.25)), OPR + f", {RULE.format(0.25)} select * from ru")
add("skeleton_violations", on_orders(lambda l: relations.rule_violations(l, relations.rules(l, 0.25))), OPR + f", {RULE.format(0.25)}, ck as (select case_id, count(*) checked, count(*) filter (ok is not true) violated from ({HELD.format('case_id, ')}) join ru using (a, b, rule) group by 1) select case_id, coalesce(checked, 0) checked, coalesce(violated, 0) violated from cases left join ck using (case_id)")
# time
B = "partition by activity, resource order by a, z, case_id"
add("batches", on_intervals(lambda l: timing.batches(l, 3600)), IVL + f", d as (select distinct activity, resource, case_id, a, z from ivl where resource is not null), o as (select *, lag(z) over ({B}) prev, max(z) over ({B} rows between unbounded preceding and 1 preceding) m from d), g as (select *, m is null or a - m > 3600000000 begun, count(*) filter (m is null or a - m > 3600000000) over ({B}) k from o), c as (select activity, resource, k, count(*) size, min(a) s0, max(a) s1, min(z) e0, max(z) e1, count(*) filter (not begun and prev <> a) loose from g group by all having count(*) >= 2) select activity, resource, s0 start_us, e1 end_us, size, case when s0 = s1 and e0 = e1 then 'simultaneous' when s0 = s1 then 'same start' when e0 = e1 then 'same end' when loose = 0 then 'sequential' else 'concurrent' end kind from c")
# models
SHIPPED = "->( 'place', *( X( 'ship A', 'ship N', 'ship R' ), tau ) )"
# the order is placed once or never: either the shipments before it are moves of the log alone, or it is, and is placed anew
COST = ", p as (select case_id, max(pos) filter (activity = 'place') placed, count(*) n, count(*) filter (activity <> 'place') ships from seq group by 1), k as (select case_id, n, cast(case when ships = 0 then 1 when placed is null then 1 else least(2, placed - 1 + case when ships = placed - 1 then 1 else 0 end) end as bigint) as cost from p) "
ALIGNED = lambda l: nets.alignments(l, nets.from_tree(trees.parse(SHIPPED)))
add("alignments", on_orders(lambda l: ALIGNED(l).drop("alignment")), ORDERS + COST + "select case_id, cost, round(1 - cost / (n + 2), 6) fitness from k")
add("alignment_fitness", on_orders(lambda l: nets.alignment_fitness(ALIGNED(l))), ORDERS + COST + "select count(*) cases, round(avg(case when cost = 0 then 1.0 else 0.0 end), 6) share_fit, round(avg(round(1 - cost / (n + 2), 6)), 4) mean_fitness from k")
PLAYED = "->( 'place', X( +( 'pick', 'bill' ), 'cancel' ), *( 'ship', 'return' ) )"
add("inductive_tree", on_orders(trees.inductive_tree), None)
add("inductive_tree_noise", on_orders(lambda l: trees.inductive_tree(l, 0.5)), None)
add("playout_dfg", lambda spark, d: dfg.frequency(trees.playout(spark, trees.parse(PLAYED), 1000)), None)
