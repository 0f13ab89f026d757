"""Queries over the order log, and of models, networks and objects; each with its SQL where SQL can say it."""

from __future__ import annotations

from ..log import order_log
from ..operators import compare, dfg, discovery, filters, ocel, org, relations, stats, timing
from ..log import variants as all_variants
from .registry import DAY, EDGES, IVL, LOG, MARKED, REL, TWO, VS, add, in_cases, on_intervals, on_log, on_objects, on_two

TAIL = LOG[LOG.index(", seq as") :]
ORDERS = (
    "with log as (select o_orderkey case_id, 'place' activity, epoch_us(o_orderdate) us, 0 event_idx, "
    "'C' || (o_custkey % 5) resource, o_totalprice as cost from orders "
    "union all select l_orderkey, 'ship ' || l_returnflag, epoch_us(l_shipdate), l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey, "
    "'S' || (l_suppkey % 7), l_extendedprice from lineitem)" + TAIL
)
SIZE = ORDERS + "select case_id, count(*) n_events from log where {} group by 1"
PICK = SIZE.format("case_id in (select case_id from {})")
OUT = SIZE.format("case_id not in (select case_id from {})")
N = "(select count(*) from cases)"
#: 1994 to 1996, in microseconds.
LOW, HIGH = 757_382_400_000_000, 851_990_400_000_000


def on_orders(f):
    return lambda spark, d: f(order_log(spark, d))


def sized(f):
    return lambda spark, d: filters.summary(f(order_log(spark, d)))


def related(f):
    return on_objects(lambda r: ocel.type_activities(f(r)))


# variants
shared = f"select variant from {VS} where n >= {{}} * {N} and n <= {{}} * {N}"
add("filter_variants", sized(lambda l: filters.variants(l, [["place"], ["place", "ship N"], ["ship N", "place"]])), PICK.format("tr where variant in ('place', 'place,ship N', 'ship N,place')"))
add("filter_variants_negative", sized(lambda l: filters.variants(l, [["place", "ship N"], ["ship N", "place"]], False)), OUT.format("tr where variant in ('place,ship N', 'ship N,place')"))
add("filter_variants_coverage", sized(lambda l: filters.variants_by_coverage(l, least=0.004)), PICK.format(f"tr where variant in ({shared.format(0.004, 1)})"))
add("filter_variants_max_coverage", sized(lambda l: filters.variants_by_coverage(l, most=0.004)), PICK.format(f"tr where variant in ({shared.format(0, 0.004)})"))
add("filter_one_case_per_variant", sized(filters.one_case_per_variant), PICK.format("(select min(case_id) case_id from tr group by variant)"))
add("filter_ends_with", sized(lambda l: filters.ends_with(l, [["place"], ["ship N", "ship A"]])), PICK.format("seq where nxt is null and (activity = 'place' or (activity = 'ship A' and prv = 'ship N'))"))
add("filter_ends_with_negative", sized(lambda l: filters.ends_with(l, [["place"]], False)), OUT.format("seq where nxt is null and activity = 'place'"))
add("order_variants", on_orders(all_variants), ORDERS + f"select * from {VS}")
add("prefix_tree", on_orders(discovery.prefix_tree), ORDERS + ", x as (select case_id, pos as depth, string_agg(activity, ',') over (partition by case_id order by pos) prefix from seq) select prefix, depth, count(*) n from x group by 1, 2")
add("variant_paths_duration", on_orders(discovery.variant_paths_duration), ORDERS + ", x as (select case_id, activity, nxt, pos, lead(us) over (partition by case_id order by us, event_idx) - us g from seq) select variant, pos step, activity source, nxt target, count(*) n, cast(sum(g) as double) / count(*) / 1e6 mean_s from x join tr using (case_id) where nxt is not null group by 1, 2, 3, 4")
# time, attributes, order
add("filter_starting_in", sized(lambda l: filters.starting_in(l, LOW, HIGH)), PICK.format(f"cases where s between {LOW} and {HIGH}"))
add("filter_completing_in", sized(lambda l: filters.completing_in(l, LOW, HIGH)), PICK.format(f"cases where e between {LOW} and {HIGH}"))
add("filter_attribute_in", sized(lambda l: filters.attribute_in(l, "activity", "ship A", LOW, HIGH)), PICK.format(f"log where activity = 'ship A' and us between {LOW} and {HIGH}"))
add("filter_numeric_cases", sized(lambda l: filters.numeric_cases(l, "cost", 1000, 5000)), PICK.format("log where cost between 1000 and 5000"))
add("filter_numeric_cases_negative", sized(lambda l: filters.numeric_cases(l, "cost", 1000, 5000, False)), OUT.format("log where cost between 1000 and 5000"))
add("filter_frequent_values", sized(lambda l: filters.frequent_values(l, "resource", 250)), SIZE.format("resource in (select resource from log group by 1 having count(*) >= 250)"))
add("filter_top_values", sized(lambda l: filters.top_values(l, "activity", 2)), SIZE.format("activity in (select activity from log group by 1 order by count(*) desc, activity limit 2)"))
add("filter_frequent_starts", sized(lambda l: filters.frequent_ends(l, 200)), PICK.format("seq where prv is null and activity in (select activity from seq where prv is null group by 1 having count(*) >= 200)"))
add("filter_frequent_ends", sized(lambda l: filters.frequent_ends(l, 200, True)), PICK.format("seq where nxt is null and activity in (select activity from seq where nxt is null group by 1 having count(*) >= 200)"))
add("filter_follows_any", sized(lambda l: filters.follows_any(l, [("place", "ship A"), ("ship R", "place")])), PICK.format("seq where (activity = 'place' and nxt = 'ship A') or (activity = 'ship R' and nxt = 'place')"))
add("filter_follows_any_negative", sized(lambda l: filters.follows_any(l, [("place", "ship A"), ("ship R", "place")], False)), OUT.format("seq where (activity = 'place' and nxt = 'ship A') or (activity = 'ship R' and nxt = 'place')"))
add("filter_next_three", sized(lambda l: filters.next_three(l, "ship N", "ship A", "ship R")), PICK.format("seq where activity = 'ship N' and nxt = 'ship A' and nxt2 = 'ship R'"))
add("filter_different_resources", sized(lambda l: filters.different_resources(l, "ship N")), PICK.format("log where activity = 'ship N' group by case_id having count(distinct resource) > 1"))
add("filter_different_resources_negative", sized(lambda l: filters.different_resources(l, "ship N", False)), OUT.format("(select case_id from log where activity = 'ship N' group by case_id having count(distinct resource) > 1)"))
add("filter_ef_relation", sized(lambda l: filters.eventually(l, "ship A", "place", False)), OUT.format("(select x.case_id from seq x join seq y using (case_id) where x.activity = 'ship A' and y.activity = 'place' and x.pos < y.pos)"))
add("filter_time_contained", sized(lambda l: filters.time_contained(l, LOW, HIGH)), PICK.format(f"cases where s >= {LOW} and e <= {HIGH}"))
add("filter_attr_cases_negative", sized(lambda l: filters.attribute_cases(l, "activity", ["ship R"], False)), OUT.format("log where activity = 'ship R'"))
add("split_at_activity", on_log(lambda l: filters.summary(filters.split_at(l, "purchase")).selectExpr("case_id.case_id as case_id", "case_id.part as part", "n_events")), LOG + ", x as (select case_id, count(*) filter (activity = 'purchase') over (partition by case_id order by pos) part from seq) select case_id, part, count(*) n_events from x group by 1, 2")
# relations and models
add("order_dfg", on_orders(dfg.frequency), ORDERS + "select activity source, nxt target, count(*) frequency from seq where nxt is not null group by 1, 2")
add("order_causal_heuristic", on_orders(dfg.dependency), EDGES.replace(LOG, ORDERS) + ", p as (select s, t from f union select t, s from f) select p.s source, p.t target, round((coalesce(f.n, 0) - coalesce(g.n, 0)) / (coalesce(f.n, 0) + coalesce(g.n, 0) + 1), 6) dependency from p left join f on f.s = p.s and f.t = p.t left join f g on g.s = p.t and g.t = p.s")
add("order_noise_filtered", on_orders(lambda l: dfg.noise_filtered(l, 0.6)), EDGES.replace(LOG, ORDERS) + ", m as (select act, max(n) most from (select s act, n from f union all select t, n from f) group by 1) select s source, t target, n frequency from f join m x on x.act = s join m y on y.act = t where n >= 0.6 * least(x.most, y.most)")
add("causal_alpha", on_orders(lambda l: dfg.causal_alpha(l, 1.0)), EDGES.replace(LOG, ORDERS) + ", m as (select act, max(n) most from (select s act, n from f union all select t, n from f) group by 1), k as (select s source, t target from f join m x on x.act = s join m y on y.act = t where n >= least(x.most, y.most)) select * from k where not exists (select 1 from k g where g.source = k.target and g.target = k.source)")
add("order_temporal_profile", on_orders(relations.temporal_profile), ORDERS + ", g as (select x.activity a, y.activity b, y.us - x.us g from seq x join seq y on x.case_id = y.case_id and x.pos < y.pos), t as (select a, b, count(*) n, cast(sum(g) as double) s, cast(sum(cast(g as hugeint) * g) as double) q from g group by 1, 2) select a, b, s / n / 1e6 mean_s, case when n > 1 then round(sqrt(greatest((q - s * s / n) / (n - 1), 0)) / 1e6, 3) else 0 end std_s from t")
add("alpha_places", on_orders(discovery.alpha_places), None)
add("replay", on_orders(lambda l: discovery.replay(l, discovery.alpha_net(l))), None)
add("replay_fitness", on_orders(lambda l: discovery.replay_fitness(discovery.replay(l, discovery.alpha_net(l)))), None)
add("footprints_fitness", on_orders(lambda l: discovery.footprints_fitness(l, dfg.footprints(l.where(f"us < {LOW}")))), ORDERS + f", f as (select activity s, nxt t, count(*) n from seq where nxt is not null group by 1, 2), e as (select activity s, lead(activity) over (partition by case_id order by us, event_idx) t from log where us < {LOW}), m as (select distinct s, t from e where t is not null) select count(*) edges, count(m.s) as allowed, round(sum(case when m.s is null then 0 else n end) / sum(n), 6) fitness from f left join m on f.s = m.s and f.t = m.t")
# resources
add("working_together_weight", on_log(org.working_together_weight), LOG + ", r as (select distinct case_id, resource from log where resource is not null) select x.resource a, y.resource b, round(count(*) / (select count(*) from log), 8) weight from r x join r y on x.case_id = y.case_id and x.resource <> y.resource group by 1, 2")
add("subcontracting", on_log(org.subcontracting), LOG + ", x as (select resource s, lead(resource) over w m, lead(resource, 2) over w t from log window w as (partition by case_id order by us, event_idx)) select s source, m target, count(*) n, round(count(*) / (select count(*) from cases), 8) weight from x where s = t group by 1, 2")
add("network_analysis", on_log(org.network), LOG + ", x as (select activity, resource s, nres t, lead(us) over (partition by case_id order by us, event_idx) - us g from seq) select s source, t target, activity, count(*) n, cast(sum(g) as double) / count(*) / 1e6 mean_s from x where s is not null and t is not null group by 1, 2, 3")
add("resource_distinct_activities", on_log(org.distinct_activities), LOG + ", r as (select resource, activity, count(*) n from log where resource is not null group by 1, 2), l as (select resource, count(*) c from seq where nxt is null group by 1) select resource, count(*) activities, max(n) most, round(sum(n) / (select count(*) from log), 8) fraction, coalesce(any_value(c), 0) completed from r left join l using (resource) group by 1")
# order log's statistics
add("order_durations", on_orders(stats.case_durations), ORDERS + "select case_id, round((e - s) / 1e6, 4) duration_s from cases")
add("order_start_activities", on_orders(stats.endpoints), ORDERS + "select activity, count(*) n from seq where prv is null group by 1")
add("concurrent_activities", on_intervals(timing.concurrent), IVL + ", n as (select *, row_number() over (partition by case_id order by a, z, event_idx) r from ivl) select least(x.activity, y.activity) a, greatest(x.activity, y.activity) b, count(*) n from n x join n y on x.case_id = y.case_id and x.r < y.r and y.a <= x.z group by 1, 2")
# logs compared
MARK = "case when case_id % 2 = 0 then 'original' else 'simulated' end lg"
for name, at, last in (("arrivals", "s", False), ("completions", "e", True)):
    add(f"compare_daily_{name}", on_two(lambda l, last=last: compare.daily(l, last)), LOG + f"select {at} // {DAY} as day, {TWO} from (select {at}, {MARK} from cases) group by 1")
add("compare_shares", on_two(compare.shares), MARKED + f", c as (select activity, {TWO} from log group by 1), t as (select activity, original / sum(original) over () x, simulated / sum(simulated) over () y from c) select activity, round(x, 6) original, round(y, 6) simulated, round(abs(x - y), 6) difference from t")
kinds = {"activities": f"select activity k, {TWO} from log group by 1", "edges": f"select (activity, nxt) k, {TWO} from seq where nxt is not null group by 1", "variants": f"select variant k, {TWO} from (select variant, {MARK} from tr) group by 1"}
each = " union all ".join(f"select '{k}' kind, round(count(*) filter (original > 0 and simulated > 0) / count(*), 6) jaccard, round(sum(case when simulated > 0 then original else 0 end) / sum(original), 6) original_in_common, round(sum(case when original > 0 then simulated else 0 end) / sum(simulated), 6) simulated_in_common from ({q})" for k, q in kinds.items())
add("compare_overlap", on_two(compare.overlap), MARKED + each)
# objects
DIGEST = "select otype, activity, count(distinct eid) as events, count(distinct oid) objects from rel where {} group by 1, 2"
add("ocel_filter_activity", related(lambda r: ocel.events_where(r, r.activity == "ship")), REL + DIGEST.format("activity = 'ship'"))
add("ocel_filter_timestamp", related(lambda r: ocel.events_where(r, r.us.between(LOW, HIGH))), REL + DIGEST.format(f"us between {LOW} and {HIGH}"))
add("ocel_filter_object_types", related(lambda r: ocel.object_types(r, ["order", "supplier"])), REL + DIGEST.format("otype in ('order', 'supplier')"))
add("ocel_filter_object_types_negative", related(lambda r: ocel.object_types(r, ["order"], False)), REL + DIGEST.format("otype <> 'order'"))
add("ocel_filter_objects", related(lambda r: ocel.objects(r, ["u1", "u2", "o1", "c1"])), REL + DIGEST.format("oid in ('u1', 'u2', 'o1', 'c1')"))
add("ocel_filter_allowed_activities", related(lambda r: ocel.allowed_activities(r, {"order": ["place"], "part": ["ship"]})), REL + DIGEST.format("(otype = 'order' and activity = 'place') or (otype = 'part' and activity = 'ship')"))
add("ocel_filter_per_type_count", related(lambda r: ocel.per_type_count(r, {"order": 1, "part": 1})), REL + DIGEST.format("eid in (select eid from rel group by 1 having count(*) filter (otype = 'order') >= 1 and count(*) filter (otype = 'part') >= 1)"))
for name, pick, last in (("start", "min", False), ("end", "max", True)):
    add(f"ocel_filter_{name}_events", related(lambda r, last=last: ocel.end_events(r, "supplier", last)), REL + DIGEST.format(f"eid in (select ({pick}((us, eid)))[2] from rel where otype = 'supplier' group by oid)"))
add("ocel_objects", on_objects(ocel.objects_summary), REL + "select oid, otype, string_agg(activity, ',' order by us, eid) lifecycle, min(us) start_us, max(us) end_us, (max(us) - min(us)) / 1e6 duration_s from rel group by 1, 2")
add("ocel_interactions", on_objects(ocel.interactions), REL + ", t as (select distinct eid, otype from rel) select x.otype a, y.otype b, count(*) as events from t x join t y on x.eid = y.eid and x.otype < y.otype group by 1, 2")
add("ocel_object_graph", on_objects(ocel.object_graph), REL + ", p as (select distinct x.oid a, y.oid b, x.otype type_a, y.otype type_b from rel x join rel y on x.eid = y.eid and x.oid < y.oid) select type_a, type_b, count(*) pairs from p group by 1, 2")
for kind, order in (("cobirth", "us, eid"), ("codeath", "us desc, eid desc")):
    add(f"ocel_{kind}_graph", on_objects(lambda r, kind=kind: ocel.object_graph(r, kind)), REL + f", e as (select eid, oid, otype from rel qualify row_number() over (partition by oid order by {order}) = 1), p as (select distinct x.oid a, y.oid b, x.otype type_a, y.otype type_b from e x join e y on x.eid = y.eid and x.oid < y.oid) select type_a, type_b, count(*) pairs from p group by 1, 2")
