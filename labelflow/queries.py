"""The catalogue: one query per operator over the driver's tables, with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelflow.functions import expressions as ex
from labelflow.operators import labels as lb
from labelflow.operators import metrics as mt
from labelflow.operators import ordering as od
from labelflow.operators import ports as pt
from labelflow.operators import routing as rt
from labelflow.operators import windows as wd
from labelflow.sources import blocks as bl
from labelflow.sources import framing as fr
from labelflow.sources import generators as gen
from labelflow.tables import epoch_seconds, messages, readings, running, table, transactions, vitals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LATTICE = lb.Lattice([["public", "client", "internal"], ["public", "audit", "internal"]])
HOUR, DAY = 3600, 86400

# --- SQL pieces
EV = "ev as (select event_id as seq, floor(epoch(ts))::bigint as ts, user_id, event_type, value, props, event_id % 3 as sens from events)"
LABEL = "case event_type when 'purchase' then 'internal' when 'signup' then 'client' when 'error' then 'audit' else 'public' end"
EL = f"{EV}, el as (select seq, ts, user_id, value, event_type, {LABEL} as label from ev)"
RD = EV + ", rd as (select seq, ts, value, case when event_type <> 'error' then 1 else 0 end as property, user_id % 3 as house, user_id % 5 as household, user_id as plug from ev)"
WORK = RD + ", work as (select * from rd where property <> 0)"
TX = EV + ", tx as (select seq, ts, sens as sensitivity, user_id as entity_id, event_type as state from ev)"
VT = EV + """, vt as (select seq, ts, case when event_type in ('view', 'click') then 'frame' else 'wearable' end as kind,
  case when event_type = 'view' then '' else 'resident-' || (user_id % 7)::varchar end as person,
  60 + trunc(value)::bigint % 40 as heart_rate, 90 + trunc(value)::bigint % 10 as spo2 from ev)"""
MS = """ms as (select l_orderkey as msg, l_linenumber as part, 'pipe-' || (l_suppkey % 7)::varchar as edge, (o_orderdate::date - date '1970-01-01')::int as origin,
  (l_shipdate::date - date '1970-01-01')::int as arrival, l_quantity::bigint as bytes,
  case l_returnflag when 'N' then 'public' when 'A' then 'client' else 'internal' end as label
  from lineitem join orders on l_orderkey = o_orderkey), lat as (select *, (arrival - origin)::bigint as latency from ms)"""


def _case(col: str, table_of: dict) -> str:
    body = " ".join(f"when '{k}' then {v!r}" if isinstance(k, str) else f"when {k} then {v!r}" for k, v in table_of.items())
    return f"(case {col} {body} end)"


def up(col: str) -> str:
    return _case(col, LATTICE.up)


def bit(col: str) -> str:
    return _case(col, LATTICE.bit)


def decode(mask: str) -> str:
    return f"coalesce({_case(mask, {m: x for x, m in LATTICE.up.items()})}, '{LATTICE.top}')"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def labeller():
    return F.when(F.col("state") == "purchase", "internal").when(F.col("state") == "signup", "client").when(F.col("state") == "error", "audit").otherwise("public")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "user_id", "value", F.col("event_type").alias("state"))
    return lb.assign(t, labeller())


# ---------------------------------------------------------------- labels
@query(f"with {EL} select seq, user_id, label from el")
def label_assign(spark, sf_dir):
    return labelled(spark, sf_dir).select("seq", "user_id", F.col("_label").alias("label"))


@query(f"with {EV} select seq, 'internal' as label from ev")
def label_const(spark, sf_dir):
    return lb.assign(transactions(spark, sf_dir), F.lit("internal")).select("seq", F.col("_label").alias("label"))


@query(f"with {EL} select seq, label as input_label, {decode(f'{up("label")} & {LATTICE.up["client"]}')} as label from el")
def label_from_input(spark, sf_dir):
    d = labelled(spark, sf_dir).withColumn("input_label", F.col("_label"))
    return lb.assign(d, LATTICE.col_join(F.col("_label"), F.lit("client"))).select("seq", "input_label", F.col("_label").alias("label"))


@query(f"with {EL} select seq, {_case(_case('label', LATTICE.down) + ' & ' + str(LATTICE.down['client']), {m: x for x, m in LATTICE.down.items()})} as label from el")
def label_meet(spark, sf_dir):
    return labelled(spark, sf_dir).select("seq", LATTICE.col_meet(F.col("_label"), F.lit("client")).alias("label"))


@query(f"with {EL}, x as (select seq, case when value > 400 then null else label end as got, label from el) select seq, coalesce(got, 'public') as label, got is null as failed from x")
def labeller_failed(spark, sf_dir):
    value, failed = ex.or_else(F.when(F.col("value") <= 400, F.col("_label")), F.lit("public"))
    return labelled(spark, sf_dir).select("seq", value.alias("label"), failed.alias("failed"))


@query(f"with {EL} select seq, user_id, label from el where ({up('label')} & {LATTICE.bit['client']}) <> 0")
def ceiling_filter(spark, sf_dir):
    return lb.check(labelled(spark, sf_dir), LATTICE, F.lit("client")).select("seq", "user_id", F.col("_label").alias("label"))


HOSTS = {0: "internal", 1: "client", 2: "public"}


@query(f"with {EL}, h as (select *, {_case('user_id % 3', HOSTS)} as host_label from el) select seq, host_label, label, ({up('label')} & {bit('host_label')}) = 0 as violation from h")
def host_check(spark, sf_dir):
    host = F.element_at(F.create_map(*[F.lit(x) for kv in HOSTS.items() for x in kv]), (F.col("user_id") % 3).cast("int"))
    d = labelled(spark, sf_dir).withColumn("host_label", host)
    return lb.check(d, LATTICE, F.col("host_label"), enforce=False).select("seq", "host_label", F.col("_label").alias("label"), F.col("_violation").alias("violation"))


@query(f"with {EL} select 'label_violation' as kind, 'sink' as node, seq::varchar as detail from el where ({up('label')} & {LATTICE.bit['client']}) = 0 union all select 'key_missing', 'router', seq::varchar from el where user_id % 50 = 0")
def violation_report(spark, sf_dir):
    d = lb.check(labelled(spark, sf_dir), LATTICE, F.lit("client"), enforce=False).withColumn("detail", F.col("seq"))
    return lb.reports((d.where("_violation"), "label_violation", "sink"), (d.where("user_id % 50 = 0"), "key_missing", "router"))


@query(f"with {MS} select edge, count(*) as total, count(*) filter (where ({up('label')} & {LATTICE.bit['client']}) = 0) as violated, round(100.0 * count(*) filter (where ({up('label')} & {LATTICE.bit['client']}) = 0) / count(*), 6) as percent from ms group by edge")
def violation_rate(spark, sf_dir):
    v = F.sum((~LATTICE.col_leq(F.col("label"), F.lit("client"))).cast("long"))
    return messages(spark, sf_dir).groupBy("edge").agg(F.count(F.lit(1)).alias("total"), v.alias("violated"), r6(v * 100.0 / F.count(F.lit(1))).alias("percent"))


@query(f"with {EL} select seq, user_id, {decode(f'bit_and({up("label")}) over (partition by user_id order by seq)')} as taint from el")
def taint_running(spark, sf_dir):
    return lb.taint(labelled(spark, sf_dir), LATTICE, "user_id", "seq").select("seq", "user_id", F.col("_taint").alias("taint"))


@query(f"with {EL} select user_id % 10 as grp, {decode(f'bit_and({up("label")})')} as label, count(*) as n from el group by 1")
def taint_grouped(spark, sf_dir):
    return labelled(spark, sf_dir).groupBy((F.col("user_id") % 10).alias("grp")).agg(LATTICE.join_agg(F.col("_label")).alias("label"), F.count(F.lit(1)).alias("n"))


@query(f"with {EL}, c as (select seq, label, case when value < 20 then 'public' else label end as output from el) select seq, label as input, output from c where ({up('label')} & {bit('output')}) = 0")
def declassified_rows(spark, sf_dir):
    d = labelled(spark, sf_dir).withColumn("output", F.when(F.col("value") < 20, "public").otherwise(F.col("_label")))
    return d.where(~LATTICE.col_leq(F.col("_label"), F.col("output"))).select("seq", F.col("_label").alias("input"), "output")


@query(f"with {EL}, p as (select seq, {decode(f'{up("label")} & {_case("user_id % 3", {k: LATTICE.up[v] for k, v in HOSTS.items()})}')} as sum_label, round(value + user_id, 6) as total from el) select * from p")
def label_propagation(spark, sf_dir):
    host = F.element_at(F.create_map(*[F.lit(x) for kv in HOSTS.items() for x in kv]), (F.col("user_id") % 3).cast("int"))
    d = labelled(spark, sf_dir).withColumn("value_label", F.col("_label")).withColumn("user_id_label", host)
    d = lb.propagate(d, LATTICE, "total", r6(F.col("value") + F.col("user_id")), "value", "user_id")
    return d.select("seq", F.col("total_label").alias("sum_label"), "total")


@query(f"with {EL}, c as (select * from el where ({up('label')} & {LATTICE.bit['client']}) <> 0) select count(*) as total, count(*) filter (where ({up('label')} & {LATTICE.bit['client']}) = 0) as violated from c")
def violations_after_check(spark, sf_dir):
    """What a checked flow still violates: nothing."""
    d = lb.check(lb.check(labelled(spark, sf_dir), LATTICE, F.lit("client")), LATTICE, F.lit("client"), enforce=False)
    return d.agg(F.count(F.lit(1)).alias("total"), F.count_if("_violation").alias("violated"))


def limit_labeller(limit: float):
    """A labeller with a parameter of its graph."""
    return F.when(F.col("value") > limit, "internal").otherwise(labeller())


@query(f"with {EL} select seq, case when value > 100 then 'internal' else label end as label from el")
def label_parameter(spark, sf_dir):
    return lb.assign(labelled(spark, sf_dir), limit_labeller(100.0)).select("seq", F.col("_label").alias("label"))


_REPORTED = "case when value < 10 then null when value > 300 then 'audit' else label end"


@query(f"with {EL}, r as (select seq, {_REPORTED} as rep from el) select seq, case when rep in ('client', 'internal') then rep else 'internal' end as label, rep is not null and rep not in ('client', 'internal') as out_of_range from r")
def label_dynamic_range(spark, sf_dir):
    d = labelled(spark, sf_dir).withColumn("_label", F.when(F.col("value") < 10, None).when(F.col("value") > 300, "audit").otherwise(F.col("_label")))
    return lb.within_range(d, LATTICE, "client", "internal").select("seq", F.col("_label").alias("label"), F.col("_out_of_range").alias("out_of_range"))


@query(f"with {EL}, n as (select seq, case when value < 10 then null else label end as a, case when user_id % 3 = 0 then null else 'client' end as b from el) select seq, a is not null and ({up('a')} & {LATTICE.bit['client']}) = 0 as violation from n")
def sink_check(spark, sf_dir):
    d = labelled(spark, sf_dir).select("seq", F.when(F.col("value") >= 10, F.col("_label")).alias("a"), F.when(F.col("user_id") % 3 != 0, "client").alias("b"))
    return lb.sink_check(d, LATTICE, ["client", "internal"], ("a", "b")).select("seq", F.col("_violation").alias("violation"))


@query(f"with {EL} select user_id % 10 as grp, {_case(f'bit_and({_case("label", LATTICE.down)})', {m: x for x, m in LATTICE.down.items()})} as label from el group by 1")
def label_meet_grouped(spark, sf_dir):
    return labelled(spark, sf_dir).groupBy((F.col("user_id") % 10).alias("grp")).agg(LATTICE.meet_agg(F.col("_label")).alias("label"))


@query(f"with {EL}, h as (select *, {_case('user_id % 3', HOSTS)} as host from el) select seq, value > user_id as larger, {decode(f'{up("label")} & {up("host")}')} as larger_label, user_id & 6 as band, host as band_label, coalesce(nullif(event_type, 'view'), user_id::varchar) as text, {decode(f'{up("label")} & {up("host")}')} as text_label from h")
def label_operators(spark, sf_dir):
    """Comparison, bitwise, coalescing and concatenating columns carry the labels of their operands."""
    host = F.element_at(F.create_map(*[F.lit(x) for kv in HOSTS.items() for x in kv]), (F.col("user_id") % 3).cast("int"))
    d = labelled(spark, sf_dir).withColumns({"value_label": F.col("_label"), "state_label": F.col("_label"), "user_id_label": host})
    u = F.col("user_id")
    d = lb.propagate(d, LATTICE, "larger", F.col("value") > u, "value", "user_id")
    d = lb.propagate(d, LATTICE, "band", u.bitwiseAND(F.lit(6)), "user_id")
    d = lb.propagate(d, LATTICE, "text", F.coalesce(F.nullif(F.col("state"), F.lit("view")), u.cast("string")), "state", "user_id")
    return d.select("seq", "larger", "larger_label", "band", "band_label", "text", "text_label")


_RULES = f"""with recursive {EV}, r as (select case when seq % 3 = 0 then 'read' else 'write' end as domain, 'u' || (user_id % 60)::varchar as source, 'u' || (seq % 60)::varchar as sink, seq % 7 <> 0 as allowed, seq as k
  from ev where (seq * 31 + user_id) % 8 = 0 and user_id % 60 < seq % 60),
n as (select distinct 'write' as domain, unnest([source, sink]) as x from r where domain = 'write' union select 'write', 'vault'),
e as (select domain, source, sink, arg_max(allowed, k) as allowed from (select * from r union all select domain, x, 'vault', true, -1 from n) group by all),
l as (select distinct domain, unnest([source, sink]) as x from e),
d(domain, source, target, distance) as (select domain, x, x, 0::bigint from l union select d.domain, d.source, e.sink, d.distance + 1 from d join e on e.domain = d.domain and e.source = d.target where e.allowed and e.source <> e.sink),
m as (select domain, source, target, min(distance) as distance from d group by all)
select m.domain, m.source, m.target, m.distance, coalesce(e.allowed, true) as may_flow from m left join e on e.domain = m.domain and e.source = m.source and e.sink = m.target"""


@query(_RULES)
def rule_distances(spark, sf_dir):
    """Distances over flow rules made from events, with forbidden edges, two domains and a rule for any label."""
    d = table(spark, sf_dir, "events").where("(event_id * 31 + user_id) % 8 = 0 and user_id % 60 < event_id % 60")
    a, b = (F.concat(F.lit("u"), c.cast("string")) for c in (F.col("user_id") % 60, F.col("event_id") % 60))
    barred, read = F.col("event_id") % 7 == 0, F.col("event_id") % 3 == 0
    text = F.when(read, F.concat(b, F.when(barred, " </- ").otherwise(" <- "), a)).otherwise(F.concat(a, F.when(barred, " -/> ").otherwise(" -> "), b))
    rules = d.select(text.alias("rule"), F.col("event_id").alias("at")).union(spark.createDataFrame([("* -> vault", -1)], "rule string, at long"))
    return lb.flow_distances(lb.flow_rules(rules, "rule", "at"))


TWO = lb.Lattice([["a_low", "a_high"], ["b_low", "b_high"]])
_TWO_LABEL = "case when user_id % 2 = 0 then case when value > 50 then 'a_high' else 'a_low' end else case when value > 50 then 'b_high' else 'b_low' end end"


@query(f"with {EV}, x as (select seq, user_id % 7 as inst, {_TWO_LABEL} as label from ev), f as (select inst, arg_min(left(label, 1), seq) as c from x group by 1) select x.seq, x.inst, x.label from x join f using (inst) where left(x.label, 1) = f.c")
def compartment_isolation(spark, sf_dir):
    side = lambda s: F.when(F.col("value") > 50, f"{s}_high").otherwise(f"{s}_low")
    d = labelled(spark, sf_dir).withColumn("inst", F.col("user_id") % 7).withColumn("_label", F.when(F.col("user_id") % 2 == 0, side("a")).otherwise(side("b")))
    return lb.first_compartment(d, TWO, "inst", "seq").select("seq", "inst", F.col("_label").alias("label"))


@query(f"with {EV}, x as (select seq, value > 80 as joins, {_TWO_LABEL} as label from ev) select seq, label from x where not (joins and left(label, 1) = 'a')")
def emission_check(spark, sf_dir):
    """Labels of two compartments join to the forbidden top, which is never emitted."""
    side = lambda s: F.when(F.col("value") > 50, f"{s}_high").otherwise(f"{s}_low")
    d = labelled(spark, sf_dir).withColumn("own", F.when(F.col("user_id") % 2 == 0, side("a")).otherwise(side("b")))
    d = d.withColumn("_label", F.when(F.col("value") > 80, TWO.col_join(F.col("own"), F.lit("b_low"))).otherwise(F.col("own")))
    return lb.emitted(d, TWO).select("seq", F.col("own").alias("label"))


@query(f"with {EV}, x as (select seq, {_TWO_LABEL} as label, user_id % 128 as grp from ev) select seq, case left(label, 1) when 'a' then '{TWO.compartment['a_low']}' else '{TWO.compartment['b_low']}' end || '/' || grp::varchar as route from x")
def compartment_lanes(spark, sf_dir):
    side = lambda s: F.when(F.col("value") > 50, f"{s}_high").otherwise(f"{s}_low")
    d = labelled(spark, sf_dir).withColumn("_label", F.when(F.col("user_id") % 2 == 0, side("a")).otherwise(side("b")))
    return rt.compartment_groups(d, TWO, F.col("user_id") % 128).select("seq", "route")


#: A lattice of 500 labels: pairs of a level out of 20 and one out of 25.
GRID = lb.Lattice([[f"g{i}_{j}" for j in range(25)] for i in range(20)] + [[f"g{i}_{j}" for i in range(20)] for j in range(25)])
_GRID = f"{EV}, g as (select seq, user_id % 100 as grp, user_id % 20 as i, seq % 25 as j from ev)"


def _on_grid(spark, sf_dir):
    d = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id"))
    return d.select("seq", (F.col("user_id") % 100).alias("grp"), F.concat(F.lit("g"), (F.col("user_id") % 20).cast("string"), F.lit("_"), (F.col("seq") % 25).cast("string")).alias("_label"))


@query(f"with {_GRID} select grp, 'g' || max(i)::varchar || '_' || max(j)::varchar as joined, 'g' || min(i)::varchar || '_' || min(j)::varchar as met, count(*) filter (where i <= 12 and j <= 9) as may_flow from g group by grp")
def wide_lattice(spark, sf_dir):
    """Joins, meets and clearance over 500 labels, masks of nine words."""
    d = _on_grid(spark, sf_dir)
    return d.groupBy("grp").agg(GRID.join_agg(F.col("_label")).alias("joined"), GRID.meet_agg(F.col("_label")).alias("met"), F.count_if(GRID.col_leq(F.col("_label"), F.lit("g12_9"))).alias("may_flow"))


@query(f"with {_GRID} select seq, 'g' || (max(i) over w)::varchar || '_' || (max(j) over w)::varchar as taint, i > 12 or j > 9 as violation from g window w as (partition by grp order by seq)")
def wide_taint(spark, sf_dir):
    """Running taint and sink checks over the same labels."""
    d = lb.taint(_on_grid(spark, sf_dir), GRID, "grp", "seq")
    return lb.sink_check(d, GRID, ["g12_20", "g19_9"]).select("seq", F.col("_taint").alias("taint"), F.col("_violation").alias("violation"))


# ---------------------------------------------------------------- routing
LANES = ["client", "internal"]
_LANE = f"case when ({up('label')} & {LATTICE.bit['client']}) <> 0 then 'client' when ({up('label')} & {LATTICE.bit['internal']}) <> 0 then 'internal' end"


@query(f"with {EL} select seq, label, {_LANE} as lane from el")
def lane_assign(spark, sf_dir):
    return rt.lanes(labelled(spark, sf_dir), LATTICE, LANES, "_label").select("seq", F.col("_label").alias("label"), "lane")


@query(f"with {EL}, l as (select {_LANE} as lane from el) select lane, round(count(*) / sum(count(*)) over (), 6) as share from l group by lane")
def lane_share(spark, sf_dir):
    n = rt.lanes(labelled(spark, sf_dir).groupBy("_label").count(), LATTICE, LANES, "_label").groupBy("lane").agg(F.sum("count").alias("n"))
    return n.select("lane", r6(F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


@query(f"with {EL} select distinct label from el where ({up('label')} & {LATTICE.bit['client']}) = 0")
def unroutable_labels(spark, sf_dir):
    ok = spark.createDataFrame([(x,) for x in LATTICE.labels if LATTICE.leq(x, "client")], "_label string")
    return labelled(spark, sf_dir).select("_label").distinct().join(ok, "_label", "left_anti").select(F.col("_label").alias("label"))


@query(f"with {EL} select seq, ({up('label')} & {LATTICE.bit['client']}) <> 0 or seq >= 500 as sent from el")
def queued_rows(spark, sf_dir):
    """Rows that no receiver may have wait; when one with a higher ceiling comes, those that wait and the new ones go, the rest waits on."""
    d = labelled(spark, sf_dir)
    sent, waiting = rt.queued(d.where("seq < 500"), None, LATTICE, ["client"])
    late, _ = rt.queued(d.where("seq >= 500"), None, LATTICE, ["client", "internal"])
    return sent.unionByName(late).select("seq", F.lit(True).alias("sent")).unionByName(waiting.select("seq", F.lit(False).alias("sent")))


@query(f"with {EL}, r as (select * from (values ('r0', 'internal'), ('r1', 'client'), ('r2', 'public')) t(receiver, ceiling)) select seq, receiver from el, r where ({up('label')} & {bit('ceiling')}) <> 0")
def broadcast_copies(spark, sf_dir):
    return rt.broadcast_copies(labelled(spark, sf_dir), LATTICE, [("r0", "internal"), ("r1", "client"), ("r2", "public")]).select("seq", "receiver")


@query(None)
def key_group(spark, sf_dir):
    g = rt.key_group(rt.canonical(("i", F.col("entity_id")), ("s", F.col("state"))))
    t = transactions(spark, sf_dir).select("entity_id", "state").distinct().withColumn("key_group", g)
    return t.withColumn("instance", rt.instance_of(F.col("key_group"), 5))


@query(f"with {EV}, o as (select i::int as instance, ((i * 128 + 6) // 7)::int as group_from, (((i + 1) * 128 + 6) // 7)::int as group_to from range(7) t(i)) select instance, group_from, group_to, count(*) as n from o join ev on user_id % 128 >= group_from and user_id % 128 < group_to group by all")
def key_ranges(spark, sf_dir):
    """The ranges of key groups that seven instances own, with the rows of events that each gets."""
    n = transactions(spark, sf_dir).groupBy((F.col("entity_id") % 128).alias("g")).agg(F.count(F.lit(1)).alias("n"))  # a row per group
    r = rt.owned_ranges(spark, 7)
    return r.join(n, (F.col("g") >= F.col("group_from")) & (F.col("g") < F.col("group_to"))).groupBy("instance", "group_from", "group_to").agg(F.sum("n").alias("n"))


@query(f"with {EV}, g as (select seq, (user_id % 128)::int as grp from ev), o as (select i::int as instance, (i * 128 + 6) // 7 as lo, ((i + 1) * 128 + 6) // 7 as hi from range(7) t(i)) select seq, grp, instance from g join o on grp >= lo and grp < hi")
def key_owner(spark, sf_dir):
    g = (F.col("entity_id") % 128).cast("int")
    return transactions(spark, sf_dir).select("seq", g.alias("grp"), rt.instance_of(g, 7).alias("instance"))


@query(f"with {MS}, n as (select edge, label, count(*) as n from ms group by all), q as (select edge, label, n / sum(n) over (partition by edge) as q, sum(n) over (partition by edge) as total from n), p as (select edge, label, p from (select distinct edge from ms), (values ('public', 0.5), ('client', 0.3), ('internal', 0.2)) v(label, p)) select edge, max(total)::bigint as n, round(sum(abs(coalesce(p, 0) - coalesce(q, 0))) / 2, 6) as distance, max(total) >= 200 and sum(abs(coalesce(p, 0) - coalesce(q, 0))) / 2 > 0.2 as drifted from p full join q using (edge, label) group by edge")
def label_drift(spark, sf_dir):
    m = messages(spark, sf_dir)
    p = F.array(*[F.struct(F.lit(x).alias("label"), F.lit(v).alias("p")) for x, v in (("public", 0.5), ("client", 0.3), ("internal", 0.2))])
    expected = m.select("edge").distinct().select("edge", F.inline(p))
    return rt.drift(m, expected).select("edge", "n", r6("distance").alias("distance"), "drifted")


# ---------------------------------------------------------------- expressions
@query(f"with {EV} select seq, starts_with(event_type, 'pu') as starts, ends_with(event_type, 'k') as ends, contains(event_type, 'i') as has, event_type || ':' || user_id::varchar as tag, event_type < 'error' as below from ev")
def expr_strings(spark, sf_dir):
    s = F.col("state")
    return transactions(spark, sf_dir).select("seq", s.startswith("pu").alias("starts"), s.endswith("k").alias("ends"), s.contains("i").alias("has"), F.concat(s, F.lit(":"), F.col("entity_id").cast("string")).alias("tag"), (s < "error").alias("below"))


@query(f"with {EV} select seq, list_contains([1, 2, 3], (user_id % 5)::int) as inside, list_contains(['click', 'view'], event_type) as watched from ev")
def expr_lists(spark, sf_dir):
    return transactions(spark, sf_dir).select("seq", F.array_contains(F.array(F.lit(1), F.lit(2), F.lit(3)), (F.col("entity_id") % 5).cast("int")).alias("inside"), F.array_contains(F.array(F.lit("click"), F.lit("view")), F.col("state")).alias("watched"))


@query(f"with {EV} select seq, -user_id as neg, user_id + 2.5::double as up, user_id - sens as diff, user_id::double = value as same, value >= 10 as large, 1500000000 + (seq * 1000000)::bigint as ns from ev")
def expr_numeric(spark, sf_dir):
    d = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "user_id", "value")
    u = F.col("user_id")
    return d.select("seq", (-u).alias("neg"), (u + 2.5).alias("up"), (u - F.col("seq") % 3).alias("diff"), ex.same(u, F.col("value")).alias("same"), (F.col("value") >= 10).alias("large"), (F.lit(ex.duration("1500ms")) + F.col("seq") * ex.duration("1ms")).alias("ns"))


@query(f"with {EV} select seq, not (value > 50) as low, value > 50 and user_id % 2 = 0 as both_of, value > 50 or event_type = 'error' as any_of, case when value > 100 then 'big' else 'small' end as size from ev")
def expr_logic(spark, sf_dir):
    d = table(spark, sf_dir, "events").withColumn("seq", F.col("event_id"))
    v = F.col("value")
    return d.select("seq", (~(v > 50)).alias("low"), ((v > 50) & (F.col("user_id") % 2 == 0)).alias("both_of"), ((v > 50) | (F.col("event_type") == "error")).alias("any_of"), F.when(v > 100, "big").otherwise("small").alias("size"))


@query(f"with {EV} select seq, try_cast(props->>'k' as bigint) as k, props->>'missing' is not null as present from ev")
def json_member(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), ex.json_member(F.col("props"), "k", "bigint").alias("k"), ex.json_member(F.col("props"), "missing", "string").isNotNull().alias("present"))


@query(f"with {EV} select seq, user_id, event_type from ev")
def struct_project(spark, sf_dir):
    d = table(spark, sf_dir, "events").select(F.struct(F.col("event_id").alias("seq"), "user_id", "event_type", "value").alias("r"))
    return d.select("r.seq", "r.user_id", "r.event_type")


@query(f"with {EV}, j as (select seq, case when seq % 10 = 0 then 'not json' else props end as payload from ev) select seq, try_cast(case when seq % 10 = 0 then null else props->>'k' end as bigint) as k, seq % 10 = 0 as bad from ev")
def schema_mismatch(spark, sf_dir):
    d = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 10 == 0, "not json").otherwise(F.col("props")).alias("payload"))
    r = F.from_json("payload", "struct<k: bigint, _corrupt: string>", {"columnNameOfCorruptRecord": "_corrupt"})
    return d.withColumn("r", r).select("seq", F.col("r.k").alias("k"), F.coalesce(F.col("r._corrupt").isNotNull(), F.lit(True)).alias("bad"))


@query("select p_partkey::bigint as part, regexp_full_match(p_name, '.*e.') as hit, regexp_full_match(p_type, 'S.*') as s_type from part")
def glob_match(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("part"), ex.glob(F.col("p_name"), "*e?").alias("hit"), ex.glob(F.col("p_type"), "S*").alias("s_type"))


@query(f"with {EV} select seq, user_id ** 2 as pw, (user_id & 6)::bigint as band, (user_id << 2)::bigint as shl, coalesce(nullif(event_type, 'view'), 'none') as nn, upper(event_type) as up, trim('  ' || event_type || ' ') as tr, replace(event_type, 'i', 'I') as rp from ev")
def expr_more(spark, sf_dir):
    d = table(spark, sf_dir, "events")
    u, s = F.col("user_id"), F.col("event_type")
    return d.select(F.col("event_id").alias("seq"), F.pow(u, F.lit(2)).alias("pw"), u.bitwiseAND(F.lit(6)).alias("band"), F.shiftleft(u, 2).alias("shl"), F.coalesce(F.nullif(s, F.lit("view")), F.lit("none")).alias("nn"), F.upper(s).alias("up"), F.trim(F.concat(F.lit("  "), s, F.lit(" "))).alias("tr"), F.replace(s, F.lit("i"), F.lit("I")).alias("rp"))


@query(f"with {EV} select seq, (60 + user_id)::varchar as fps, event_type as mode from ev")
def config_parse(spark, sf_dir):
    m = ex.config(F.concat(F.lit("fps="), (60 + F.col("entity_id")).cast("string"), F.lit(";mode="), F.col("state")))
    return transactions(spark, sf_dir).withColumn("m", m).select("seq", F.element_at("m", "fps").alias("fps"), F.element_at("m", "mode").alias("mode"))


# ---------------------------------------------------------------- sources
@query(f"with {EV} select (user_id)::varchar as entity_id, seq::varchar as transaction_id, event_type as state from ev where seq % 10 <> 0")
def transaction_source(spark, sf_dir):
    line = F.when(F.col("seq") % 10 == 0, F.concat_ws(",", F.col("entity_id").cast("string"), F.col("state"))).otherwise(F.concat_ws(",", F.col("entity_id").cast("string"), F.col("seq").cast("string"), "state"))
    return gen.parse_transactions(transactions(spark, sf_dir).select(line.alias("value"))).select("entity_id", "transaction_id", "state")


@query(f"with {RD} select seq::varchar as id, ts, round(value, 6) as value, property::bigint as property, plug::varchar as plug from rd where seq % 9 <> 0")
def plug_source(spark, sf_dir):
    c = [F.col(x).cast("string") for x in ("seq", "ts", "value", "property", "plug", "household", "house")]
    line = F.concat_ws(",", *c[:3], F.concat(c[3], F.lit("x")), *c[4:6], F.when(F.col("seq") % 9 == 0, None).otherwise(c[6]))
    return gen.parse_plugs(readings(spark, sf_dir).select(line.alias("value"))).select("id", "ts", r6("value").alias("value"), "property", "plug")


@query("with d as (select doc_id, string_split(text, chr(10)) as p from documents where text is not null), l as (select doc_id, regexp_replace(unnest(p), chr(13) || '$', '') as line, unnest(range(len(p))) as k, len(p) as n from d) select doc_id, count(*) as n_lines, sum(length(line))::bigint as chars from l where not (k = n - 1 and line = '') group by doc_id")
def segment_lines(spark, sf_dir):
    d = fr.segment(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", fr.lines())
    return d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length(F.decode("message", "UTF-8"))).alias("chars"))


@query("with d as (select doc_id, string_split(text, '.') as p from documents where contains(text, '.')) select doc_id, (len(p) - 1)::bigint as n from d")
def segment_delimited(spark, sf_dir):
    d = fr.segment(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", fr.delimiter(b"."))
    return d.where("kind = 'message'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("select doc_id, 2::bigint as n, octet_length(encode(text))::bigint + 3 as bytes from documents where text is not null")
def segment_prefixed(spark, sf_dir):
    """Frames and their bytes of every document, those too long for a message (oversize) included."""
    text = F.encode("text", "UTF-8")
    size = F.octet_length("text")
    frame = F.concat(F.unhex(F.lpad(F.hex(size), 8, "0")), text, F.unhex(F.lit("00000003")), F.encode(F.lit("end"), "UTF-8"))
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", frame.alias("data"))
    return fr.segment(d, "data", fr.length_prefix(4)).where("kind in ('message', 'oversize')").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.octet_length("message"), "dropped")).alias("bytes"))


@query("select doc_id, (octet_length(encode(text)) // 64)::bigint as n, (octet_length(encode(text)) % 64)::bigint as dropped from documents where octet_length(encode(text)) > 0")
def segment_fixed(spark, sf_dir):
    d = fr.segment(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", fr.fixed(64))
    return d.groupBy("doc_id").agg(F.sum((F.col("kind") == "message").cast("long")).alias("n"), F.sum("dropped").alias("dropped"))


@query("with p as (select page_id, regexp_extract_all(html, '(?s)<li>.*?</li>') as m from pages) select page_id, len(m)::bigint as n, list_sum(list_transform(m, lambda x: octet_length(encode(x))))::bigint as bytes from p where len(m) > 0")
def segment_markers(spark, sf_dir):
    d = fr.segment(table(spark, sf_dir, "pages").select("page_id", "html"), "html", fr.markers(b"<li>", b"</li>"))
    return d.where("kind = 'message'").groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("message")).alias("bytes"))


@query(f"with {EV} select seq, unnest([0, length(props) + 1, length(props) + 13, length(props) + 14]) as offset, unnest(['message', 'message', 'unframed', 'message']) as kind, unnest([props, '{{\"a\": \"}}{{\"}}', null, '{{}}']) as message from ev")
def segment_json(spark, sf_dir):
    """Objects one after another, with a brace in a string and loose text between them."""
    data = F.concat(F.col("props"), F.lit(' {"a": "}{"} '), F.lit("x{}"))
    d = fr.segment(table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), data.alias("data")), "data", fr.json_objects())
    return d.select("seq", "offset", "kind", F.decode("message", "UTF-8").alias("message"))


#: Bytes of the blocks that streams of the queries below are cut into; most messages of some size span blocks.
STREAM_BLOCK = 1 << 14
TEXT_STREAMS = "s as (select source as stream, string_agg(coalesce(text, ''), '' order by doc_id) as t from documents group by source)"


@query(f"with {TEXT_STREAMS}, p as (select stream, string_split(t, chr(10)) as p from s), l as (select stream, unnest(p) as line, unnest(range(len(p))) as k, len(p) as n from p), o as (select *, (sum(strlen(line) + 1) over (partition by stream order by k))::bigint - strlen(line) - 1 as offset from l) select stream, o.offset, md5(regexp_replace(line, chr(13) || '$', '')) as digest from o where not (k = n - 1 and line = '')")
def stream_lines(spark, sf_dir):
    """The documents of a source as chunks of one stream: its lines run on over chunks and blocks."""
    chunks = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    out = bl.segment_stream(bl.stream_blocks(chunks, "source", "doc_id", "text", STREAM_BLOCK), fr.lines())
    return out.select("stream", "offset", F.md5("message").alias("digest"))


@query(f"with {TEXT_STREAMS}, p as (select stream, strlen(t) as size, list_slice(string_split(t, 'the '), 1, -2) as p, string_split(t, 'the ')[-1] as rest from s), l as (select stream, unnest(p) || 'the ' as m, unnest(range(len(p))) as k from p) select stream, 'message' as kind, (sum(strlen(m)) over (partition by stream order by k))::bigint - strlen(m) as offset, md5(m) as digest, 0::bigint as dropped from l union all select stream, 'truncated', size - strlen(rest), null, strlen(rest) from p where rest <> ''")
def stream_delimited(spark, sf_dir):
    """The same streams cut behind a delimiter of several bytes, which blocks cut too."""
    chunks = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    out = bl.segment_stream(bl.stream_blocks(chunks, "source", "doc_id", "text", STREAM_BLOCK), fr.delimiter(b"the "))
    return out.select("stream", "kind", "offset", F.md5("message").alias("digest"), "dropped")


@query("with s as (select (page_id % 5)::varchar as stream, string_agg(html, '' order by page_id) as t from pages group by 1), m as (select stream, t, regexp_extract_all(t, '(?s)<li>.*?</li>') as m from s), b as (select stream, len(m)::bigint as n, coalesce(list_sum(list_transform(m, lambda x: strlen(x))), 0)::bigint as bytes, strlen(t)::bigint as size from m) select stream, n, bytes, size - bytes as unframed from b")
def stream_markers(spark, sf_dir):
    """Pages as chunks of five streams: list items, and the bytes outside of them."""
    chunks = table(spark, sf_dir, "pages").select((F.col("page_id") % 5).alias("s"), "page_id", "html")
    out = bl.segment_stream(bl.stream_blocks(chunks, "s", "page_id", "html", STREAM_BLOCK), fr.markers(b"<li>", b"</li>"))
    whole = F.col("kind") == "message"
    return out.groupBy("stream").agg(F.count_if(whole).alias("n"), F.sum(F.when(whole, F.octet_length("message")).otherwise(0)).alias("bytes"), F.sum(F.when(~whole, F.col("dropped")).otherwise(0)).alias("unframed"))


@query(f"with {EV}, s as (select (user_id % 8)::varchar as stream, seq, props as message, case when seq % 5 = 0 then ' x\"' else '' end as loose from ev), o as (select *, (sum(strlen(message) + strlen(loose)) over (partition by stream order by seq))::bigint - strlen(message) - strlen(loose) as offset from s) select stream, 'message' as kind, o.offset, message, 0::bigint as dropped from o union all select stream, 'unframed', o.offset + strlen(message) + 1, null, 2 from o where loose <> ''")
def stream_json(spark, sf_dir):
    """Objects one after another, each in two chunks, with loose text and odd quotes between some."""
    ev = table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("s"), F.col("event_id").alias("seq"), F.concat("props", F.when(F.col("event_id") % 5 == 0, ' x"').otherwise("")).alias("t"))
    halves = F.explode(F.array(F.struct((2 * F.col("seq")).alias("k"), F.substring("t", 1, 4).alias("c")), F.struct((2 * F.col("seq") + 1).alias("k"), F.expr("substring(t, 5)").alias("c"))))
    chunks = ev.select("s", halves.alias("h")).select("s", "h.k", "h.c")
    out = bl.segment_stream(bl.stream_blocks(chunks, "s", "k", "c", STREAM_BLOCK), fr.json_objects())
    return out.select("stream", "kind", "offset", F.decode("message", "UTF-8").alias("message"), "dropped")


@query("with d as (select source as stream, doc_id, coalesce(text, '') as t from documents) select stream, (sum(strlen(t) + 4) over (partition by stream order by doc_id))::bigint - strlen(t) - 4 as offset, md5(t) as digest from d")
def stream_prefixed(spark, sf_dir):
    """Every document as a frame behind its length, the frames of a source one stream."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    chunks = table(spark, sf_dir, "documents").select("source", "doc_id", F.concat(F.unhex(F.lpad(F.hex(F.octet_length(text)), 8, "0")), text).alias("frame"))
    out = bl.segment_stream(bl.stream_blocks(chunks, "source", "doc_id", "frame", STREAM_BLOCK), fr.length_prefix(4))
    return out.select("stream", "offset", F.md5("message").alias("digest"))


@query(f"with {EV}, s as (select user_id % 97 as k, case when seq % 11 = 0 then 'delete' else 'set' end as op, value as v, seq from ev), l as (select k, arg_max(op, seq) as op, arg_max(v, seq) as v from s group by k) select k, v from l where op <> 'delete'")
def registry_feed(spark, sf_dir):
    """A snapshot with the whole change feed, from before the snapshot on and every change twice, equals the fold of all changes."""
    d = table(spark, sf_dir, "events").select((F.col("user_id") % 97).alias("k"), F.when(F.col("event_id") % 11 == 0, "delete").otherwise("set").alias("op"), F.col("value").alias("v"), F.col("event_id").alias("seq"))
    snapshot = mt.registry_fold(d.where("seq <= 400"), "k", "seq", "op", "v")
    return mt.apply_feed(snapshot, 400, d.unionByName(d), "k", "seq", "op", "v")


@query(f"with {EV}, k as (select ts, min(seq) as first, arg_max(value, seq) as value from ev group by ts) select ts, value from k order by first desc limit 300")
def latest_keys(spark, sf_dir):
    return mt.latest_keys(table(spark, sf_dir, "events").select("event_id", "value", epoch_seconds("ts").alias("ts")), "ts", "event_id", "value", 300)


@query(f"with {EV} select user_id % 10 as agent, max(seq) as max_rss, round(avg(value), 6) as mean_cpu from ev group by 1")
def agent_usage(spark, sf_dir):
    d = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("agent"), F.col("event_id").alias("rss"), F.col("value").alias("cpu"))
    return mt.agent_usage(d, "agent", "rss", "cpu").withColumn("mean_cpu", r6("mean_cpu"))


@query(f"with {EV} select seq, 'vitals' as kind, user_id::varchar as person, event_type as state, 3 as keys from ev")
def object_merge(spark, sf_dir):
    text = lambda *kv: F.create_map(*[F.lit(x) if i % 2 == 0 else x for i, x in enumerate(kv)])
    d = transactions(spark, sf_dir)
    m = ex.merged(text("kind", F.lit("history"), "person", F.col("entity_id").cast("string")), text("state", F.col("state"), "kind", F.lit("vitals")))
    return d.withColumn("m", m).select("seq", *[F.element_at("m", k).alias(k) for k in ("kind", "person", "state")], F.size("m").alias("keys"))


@query(f"with {EV} select seq, seq * 1000000 + 1500000000 as later, seq * 1000000 - 250000 as sooner from ev")
def expr_durations(spark, sf_dir):
    ns = F.col("seq") * ex.duration("1ms")
    return transactions(spark, sf_dir).select("seq", ex.plus_duration(ns, "1500ms").alias("later"), ex.plus_duration(ns, "250us", -1).alias("sooner"))


@query(f"with {EV}, s as (select user_id % 97 as k, case when seq % 11 = 0 then 'delete' else 'set' end as op, value as v, seq from ev), l as (select k, arg_max(op, seq) as op, arg_max(v, seq) as v from s group by k) select k, v from l where op <> 'delete'")
def registry_fold(spark, sf_dir):
    d = table(spark, sf_dir, "events").select((F.col("user_id") % 97).alias("k"), F.when(F.col("event_id") % 11 == 0, "delete").otherwise("set").alias("op"), F.col("value").alias("v"), F.col("event_id").alias("seq"))
    return mt.registry_fold(d, "k", "seq", "op", "v")


# ---------------------------------------------------------------- fraud scores
MODEL = f"{TX}, st as (select lag(state) over (partition by entity_id order by seq) as prev, state as cur from tx), md as (select prev, cur, count(*) / sum(count(*)) over (partition by prev) as p from st where prev is not null group by prev, cur)"
FIVE = "five as (select *, lag(state, 1) over w as s1, lag(state, 2) over w as s2, lag(state, 3) over w as s3, lag(state, 4) over w as s4 from tx window w as (partition by entity_id order by seq))"


def _scored(term: str, extra: str = "") -> str:
    joins = " ".join(f"left join md m{i} on m{i}.prev = {a} and m{i}.cur = {b} {extra.format(i=i, a=a)}" for i, (a, b) in enumerate((("s4", "s3"), ("s3", "s2"), ("s2", "s1"), ("s1", "state"))))
    score = " + ".join(f"({term.format(i=i, a=a, b=b)})" for i, (a, b) in enumerate((("s4", "s3"), ("s3", "s2"), ("s2", "s1"), ("s1", "state"))))
    return f"{MODEL}, {FIVE}, ent as (select prev, -sum(p * ln(p)) as e, arg_min(cur, [-p, 0]) as b0 from md group by prev), best as (select prev, cur from (select *, row_number() over (partition by prev order by p desc, cur) as k from md) where k = 1), sc as (select seq, entity_id, case when s4 is null then 0 else ({score}) / 4 end as score, case when s4 is null then '' else concat_ws(',', s4, s3, s2, s1, state) end as states from five {joins})"


@query(f"with {MODEL} select prev, cur, round(p, 6) as p from md")
def fraud_model(spark, sf_dir):
    return wd.transition_model(transactions(spark, sf_dir)).select("prev", "cur", r6("p").alias("p"))


def _scores(spark, sf_dir, algorithm, threshold):
    t = transactions(spark, sf_dir)
    return wd.sequence_scores(t, wd.transition_model(t), algorithm, threshold)


_MISS = "1 - coalesce(m{i}.p, 0)"


@query(f"with {_scored(_MISS)} select seq, entity_id, round(score, 6) as score, states, round(score, 6) > 0.8 as outlier from sc")
def fraud_score(spark, sf_dir):
    d = _scores(spark, sf_dir, "missProbability", 0.8).withColumn("score", r6("score"))
    return d.select("seq", "entity_id", "score", "states", (F.col("score") > 0.8).alias("outlier"))


@query(f"with {_scored(_MISS)} select seq, entity_id, round(score, 6) as score, round(score, 6) > 0.96 as outlier from sc")
def fraud_score_strict(spark, sf_dir):
    d = _scores(spark, sf_dir, "missProbability", 0.96).withColumn("score", r6("score"))
    return d.select("seq", "entity_id", "score", (F.col("score") > 0.96).alias("outlier"))


@query(f"with {_scored(_MISS)} select entity_id, count(*) as n, round(max(score), 6) as top from sc where round(score, 6) > 0.8 group by entity_id")
def fraud_outliers(spark, sf_dir):
    d = _scores(spark, sf_dir, "missProbability", 0.8)
    return d.where(r6("score") > 0.8).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), r6(F.max("score")).alias("top"))


@query(f"with {_scored('case when b{i}.cur = {b} then 0.0 else 1.0 end', 'left join best b{i} on b{i}.prev = {a}')} select seq, entity_id, round(score, 6) as score from sc")
def fraud_missrate(spark, sf_dir):
    return _scores(spark, sf_dir, "missRate", 0.96).select("seq", "entity_id", r6("score").alias("score"))


@query(f"with {_scored('(1 - coalesce(m{i}.p, 0)) / (1 + e{i}.e)', 'left join ent e{i} on e{i}.prev = {a}')} select seq, entity_id, round(score, 6) as score from sc")
def fraud_entropy(spark, sf_dir):
    return _scores(spark, sf_dir, "entropyReduction", 0.96).select("seq", "entity_id", r6("score").alias("score"))


# ---------------------------------------------------------------- smart grid
def work(spark, sf_dir):
    return readings(spark, sf_dir).where("property <> 0")


_TOPS = "tops as (select *, max(ts) over (order by seq) as top from work), firsts as (select top as level, min(seq) as by_seq from tops group by top)"


@query(f"with {WORK}, {_TOPS} select 'Add' as action, ts, seq, value, seq as by from work union all select 'Remove', ts, seq, value, by_seq from tops asof join firsts on tops.top + 3600 <= firsts.level")
def window_changelog(spark, sf_dir):
    return wd.window_changelog(work(spark, sf_dir)).select("action", "ts", "seq", "value", "by")


@query(f"with {WORK} select seq, ts, round(quantile_cont(value, 0.5) over (order by ts range between 3599 preceding and current row), 6) as median from work")
def global_median(spark, sf_dir):
    return wd.sliding_median(work(spark, sf_dir)).select("seq", "ts", r6("median").alias("median"))


PLUG = "pm as (select seq, ts, house, household, plug, quantile_cont(value, 0.5) over (partition by house, household, plug order by ts range between 86399 preceding and current row) as median from work)"


@query(f"with {WORK}, {PLUG} select seq, house || ':' || household || ':' || plug as key, ts, round(median, 6) as median from pm")
def plug_median(spark, sf_dir):
    d = wd.sliding_median(work(spark, sf_dir), ("house", "household", "plug"), length=DAY)
    return d.select("seq", F.concat_ws(":", *[F.col(c).cast("string") for c in ("house", "household", "plug")]).alias("key"), "ts", r6("median").alias("median"))


@query(f"with {WORK}, f as (select * from (select *, row_number() over (partition by ts order by seq) as k from work) where k = 1) select f.ts, f.seq, round(median(w.value), 6) as median from f join work w on w.ts between f.ts - 3599 and f.ts and (w.ts < f.ts or w.seq = f.seq) group by f.ts, f.seq")
def global_median_first(spark, sf_dir):
    return wd.first_reading_median(work(spark, sf_dir)).select("ts", "seq", r6("median").alias("median"))


GM = "gm as (select ts, median(value) over (order by ts range between 86399 preceding and current row) as gmed, row_number() over (partition by ts order by seq) as k from work)"
JOINED = f"{WORK}, {PLUG}, {GM}, j as (select pm.*, gmed from pm join gm using (ts) where k = 1)"


def _medians(spark, sf_dir):
    w = work(spark, sf_dir)
    plug = wd.sliding_median(w, ("house", "household", "plug"), length=DAY, name="plug_median")
    overall = wd.time_medians(w, length=DAY, name="global_median")
    return plug, overall


@query(f"with {JOINED} select seq, plug, round(median, 6) as plug_median, round(gmed, 6) as global_median, round(gmed, 6) < round(median, 6) as outlier from j")
def median_join(spark, sf_dir):
    plug, overall = _medians(spark, sf_dir)
    d = plug.join(overall, "ts").withColumns({c: r6(c) for c in ("plug_median", "global_median")})
    return d.select("seq", "plug", "plug_median", "global_median", (F.col("global_median") < F.col("plug_median")).alias("outlier"))


_OUT = """, f as (select *, {grp} as grp, round(gmed, 6) < round(median, 6) as flag from j), g as (select *, lag(flag, 1, false) over w as was, row_number() over w = 1 as fresh from f window w as (partition by grp, house, plug order by seq)),
h as (select *, sum(fresh::int) over (partition by grp order by seq) as members, sum(flag::int - was::int) over (partition by grp order by seq) as outliers from g)
select ts - 86400 as window_start, ts as window_end, house, plug, seq, round(outliers / members, 6) as share from h where flag <> was"""


def _outliers(spark, sf_dir, per_house):
    plug, overall = _medians(spark, sf_dir)
    d = wd.outlier_changes(plug.withColumn("plug_median", r6("plug_median")), overall.withColumn("global_median", r6("global_median")), per_house)
    return d.withColumn("share", r6("share"))


@query(f"with {JOINED}" + _OUT.format(grp="house"))
def outlier_changes(spark, sf_dir):
    return _outliers(spark, sf_dir, True)


@query(f"with {JOINED}" + _OUT.format(grp="0"))
def outlier_changes_all_houses(spark, sf_dir):
    return _outliers(spark, sf_dir, False)


def _slices(keys: str, width: int) -> str:
    return f"t as (select *, min(ts) over (partition by {keys}) as t0 from work), sl as (select {keys}, greatest(0, ceil((ts - t0) / {width}.0)::bigint - 1) as slice, avg(value) as avg_value, count(*) as n, min(t0) as t0 from t group by {keys}, slice)"


@query(f"with {WORK}, {_slices('house', 60)} select house, slice, t0 + slice * 60 as slice_start, round(avg_value, 6) as avg_value, n from sl")
def slice_avg_house(spark, sf_dir):
    return wd.slice_averages(work(spark, sf_dir), ("house",)).withColumn("avg_value", r6("avg_value"))


@query(f"with {WORK}, {_slices('house, household, plug', 3600)} select house, household, plug, slice, t0 + slice * 3600 as slice_start, round(avg_value, 6) as avg_value, n from sl")
def slice_avg_plug(spark, sf_dir):
    return wd.slice_averages(work(spark, sf_dir), ("house", "household", "plug"), width=HOUR).withColumn("avg_value", r6("avg_value"))


@query(f"with {WORK}, {_slices('house', 3600)}, h as (select c.house, c.slice, median(o.avg_value) as usual from sl c join sl o on o.house = c.house and o.slice > 0 and o.slice % 24 = (c.slice + 1) % 24 and o.slice <= c.slice + 1 - 24 group by all) select sl.house, sl.slice, t0 + sl.slice * 3600 + 7200 as for_time, round(avg_value + coalesce(usual, 0), 6) as predicted from sl left join h using (house, slice)")
def load_forecast(spark, sf_dir):
    avg = wd.slice_averages(work(spark, sf_dir), ("house",), width=HOUR)
    return wd.load_forecast(avg, ("house",), width=HOUR, per_day=24).withColumn("predicted", r6("predicted"))


# ---------------------------------------------------------------- assisted living
FRAMES = f"{VT}, fr as (select *, case when person = '' then 'unknown' else person end as patient_id, row_number() over (order by seq) % 45 = 0 as fall from vt where kind = 'frame')"


@query(f"with {FRAMES} select seq, ts, patient_id, fall from fr")
def fall_events(spark, sf_dir):
    return wd.fall_events(vitals(spark, sf_dir).where("kind = 'frame'")).select("seq", "ts", "patient_id", "fall")


@query(f"with {VT}, p as (select *, coalesce(nullif(person, ''), 'unknown') as patient_id from vt) select seq, patient_id, count(*) over w as events, count(*) filter (where kind = 'wearable') over w as readings from p window w as (partition by patient_id order by seq)")
def health_counts(spark, sf_dir):
    d = vitals(spark, sf_dir).withColumn("patient_id", F.coalesce(F.nullif(F.col("person"), F.lit("")), F.lit("unknown")))
    d = running(d, "seq", ("patient_id",), events=("count", F.lit(1)), readings=("count", F.when(F.col("kind") == "wearable", 1)))
    return d.select("seq", "patient_id", F.col("events").cast("long").alias("events"), F.col("readings").cast("long").alias("readings"))


@query(f"with {FRAMES}, d as (select vt.seq, fr.fall, vt.heart_rate, vt.spo2, vt.kind from vt left join fr using (seq)) select seq, case when coalesce(fall, false) then 'high' when kind = 'wearable' and (heart_rate > 95 or spo2 < 95) then 'elevated' else 'normal' end as risk from d")
def diagnosis(spark, sf_dir):
    v = vitals(spark, sf_dir)
    falls = wd.fall_events(v.where("kind = 'frame'")).select("seq", "fall")
    wear = F.col("kind") == "wearable"
    d = v.join(falls, "seq", "left")
    return d.select("seq", wd.risk(F.col("fall"), F.when(wear, F.col("heart_rate")), F.when(wear, F.col("spo2"))).alias("risk"))


@query(f"with {VT} select coalesce(nullif(person, ''), 'unknown') as patient_id, max(seq) as last_seq, arg_max(heart_rate, seq) as heart_rate, count(*) as served from vt group by 1")
def latest_per_patient(spark, sf_dir):
    p = F.coalesce(F.nullif(F.col("person"), F.lit("")), F.lit("unknown")).alias("patient_id")
    return vitals(spark, sf_dir).groupBy(p).agg(F.max("seq").alias("last_seq"), F.max_by("heart_rate", "seq").alias("heart_rate"), F.count(F.lit(1)).alias("served"))


@query(f"with {FRAMES} select count(*) as records, count(*) filter (where fall) as falls from fr")
def notify_counts(spark, sf_dir):
    return wd.fall_events(vitals(spark, sf_dir).where("kind = 'frame'")).agg(F.count(F.lit(1)).alias("records"), F.count_if("fall").alias("falls"))


@query(f"with {VT} select seq, kind from vt where kind = 'frame' union all select seq, 'copy' from vt where kind = 'wearable'")
def edge_union(spark, sf_dir):
    v = vitals(spark, sf_dir).select("seq", "kind")
    return v.where("kind = 'frame'").unionByName(v.where("kind = 'wearable'").withColumn("kind", F.lit("copy")))


# ---------------------------------------------------------------- ordering
_JIT = "tx2 as (select seq, entity_id % 20 as port, ts - (seq * 7919 % 11) * 7200 as t from tx)"


def jittered(spark, sf_dir):
    return transactions(spark, sf_dir).select("seq", (F.col("entity_id") % 20).alias("port"), (F.col("ts") - (F.col("seq") * 7919 % 11) * 7200).alias("t"))


@query(f"with {TX}, {_JIT}, w as (select *, max(t) over (partition by port order by seq rows between unbounded preceding and 1 preceding) - 36000 as wm from tx2) select seq, port, exists (select 1 from tx2 y where y.port = w.port and y.seq < w.seq and y.t > w.t and y.t <= w.wm) as late from w")
def late_routes(spark, sf_dir):
    return od.late_single_stream(jittered(spark, sf_dir), "port", "seq", "t", 36000).select("seq", "port", "late")


def _merged(streams: int) -> str:
    """Messages with the arrival that releases each and whether it is late, word by word from the definition."""
    tops = ", ".join(f"coalesce(max(case when seq % {streams} = {k} then t end) over w, 9000000000000) as m{k}" for k in range(streams))
    return f"""{_JIT}, w0 as (select *, {tops} from tx2 window w as (partition by port order by seq)),
w1 as (select seq, port, t, least({", ".join(f"m{k}" for k in range(streams))}) - 36000 as wm from w0),
rl as (select x.port, x.seq, x.t, min(y.seq) as r from w1 x left join w1 y on y.port = x.port and y.seq >= x.seq and y.wm >= x.t group by all),
mg as (select x.port, x.seq, x.t, any_value(x.r) as r, count(y.seq) > 0 as late from rl x left join rl y on y.port = x.port and y.r < x.seq and y.t > x.t group by all)"""


@query(f"with {TX}, {_merged(1)} select port, count(*) filter (where late) as dropped, count(*) filter (where not late) as released from mg group by port")
def ordered_merge(spark, sf_dir):
    d = jittered(spark, sf_dir).withColumn("stream", F.lit(0))
    m = od.ordered_merge(d, "port", "stream", (0,), "seq", "t", 36000)
    return m.groupBy("port").agg(F.count_if(F.col("outcome") == "dropped").alias("dropped"), F.count_if(F.col("outcome") == "released").alias("released"))


def _streams(spark, sf_dir):
    return jittered(spark, sf_dir).withColumn("stream", (F.col("seq") % 3).cast("int"))


@query(f"with {TX}, {_merged(3)} select port, seq, t, case when late then 'routed' else 'released' end as outcome, case when late then seq else r end as emitted_at from mg")
def ordered_merge_streams(spark, sf_dir):
    return od.ordered_merge(_streams(spark, sf_dir), "port", "stream", (0, 1, 2), "seq", "t", 36000, on_late="route").drop("stream")


@query(f"with {TX}, {_merged(3)} select port, seq, case when late then 'late' else 'released' end as outcome, row_number() over (partition by port order by case when late then seq else r end nulls last, not late, t, seq % 3, seq) as position from mg")
def ordered_merge_order(spark, sf_dir):
    m = od.ordered_merge(_streams(spark, sf_dir), "port", "stream", (0, 1, 2), "seq", "t", 36000, on_late="pass")
    return od.in_order(m, "port", "stream", "seq", "t").select("port", "seq", "outcome", F.col("position").cast("long").alias("position"))


@query("with d as (select distinct l_orderkey as k, l_linenumber::bigint as s from lineitem where l_quantity > 10), g as (select k, s, coalesce(lag(s) over (partition by k order by s), -1) as p from d) select k, p + 1 as gap_from, s - 1 as gap_to from g where s > p + 1")
def sequence_gaps(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").where("l_quantity > 10").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("s"))
    return od.sequence_gaps(d, "k", "s")


@query(f"with {TX} select entity_id, ts // 86400 as day, max(seq) as seq from tx group by all")
def sequence_dedup(spark, sf_dir):
    d = transactions(spark, sf_dir).select("entity_id", F.floor(F.col("ts") / DAY).alias("day"), "seq")
    return od.sequence_dedup(d, "entity_id", "day", "seq")


@query(f"with {TX}, {_JIT}, m as (select *, max(t) over (partition by port order by seq rows between unbounded preceding and 1 preceding) - 50000 as promised_from from tx2) select seq, port, t, promised_from from m where t < promised_from")
def order_promise(spark, sf_dir):
    return od.broken_promises(jittered(spark, sf_dir), "port", "seq", "t", 50000).select("seq", "port", "t", "promised_from")


@query(f"with {EV} select seq, user_id, row_number() over (order by seq) - 1 as origin_seq from ev")
def sequence_origin(spark, sf_dir):
    d = running(transactions(spark, sf_dir), "seq", n=("count", F.lit(1)))
    return d.select("seq", F.col("entity_id").alias("user_id"), (F.col("n") - 1).cast("long").alias("origin_seq"))


# ---------------------------------------------------------------- measurements
def latencies(spark, sf_dir):
    return messages(spark, sf_dir).withColumn("latency", (F.col("arrival") - F.col("origin")).cast("long"))


@query(f"with {MS} select edge, count(*) as n, round(avg(latency), 6) as mean, quantile_disc(latency, 0.5) as p50, quantile_disc(latency, 0.95) as p95, quantile_disc(latency, 0.99) as p99, max(latency) as max from lat group by edge")
def latency_nearest(spark, sf_dir):
    return mt.latency_nearest(latencies(spark, sf_dir), ("edge",), "latency").withColumn("mean", r6("mean")).withColumns({c: F.col(c).cast("long") for c in ("p50", "p95", "p99")})


@query(f"with {MS} select edge, round(quantile_cont(latency, 0.5), 6) as p50, round(quantile_cont(latency, 0.95), 6) as p95, round(quantile_cont(latency, 0.99), 6) as p99, round(quantile_cont(latency, 0.01), 6) as p1 from lat group by edge")
def latency_linear(spark, sf_dir):
    return mt.latency_linear(latencies(spark, sf_dir), ("edge",), "latency").select("edge", *[r6(c).alias(c) for c in ("p50", "p95", "p99", "p1")])


@query(f"with {MS}, s as (select edge, list_sort(list(latency)) as l, count(*) as n from lat group by edge) select edge, l[least(floor(n * 0.5), n - 1)::bigint + 1] as p50, l[least(floor(n * 0.95), n - 1)::bigint + 1] as p95, l[least(floor(n * 0.99), n - 1)::bigint + 1] as p99 from s")
def latency_floor(spark, sf_dir):
    return mt.latency_floor(latencies(spark, sf_dir), ("edge",), "latency")


@query(f"with {MS}, v as (select edge, latency, sum(bytes) as w from lat group by all), c as (select *, sum(w) over (partition by edge order by latency) as upto, sum(w) over (partition by edge) as total from v) select edge, round(sum(latency * w) / sum(w), 6) as mean, min(latency) filter (where upto >= (total + 1) // 2) as median, max(latency) as max from c group by edge")
def latency_weighted(spark, sf_dir):
    return mt.latency_weighted(latencies(spark, sf_dir), ("edge",), "latency", "bytes").withColumn("mean", r6("mean"))


@query(f"with {MS}, e as (select edge, min(latency) as lo, max(latency) as hi, count(*) as total from lat group by edge) select edge, least(19, floor((latency - lo) * 20 / (hi - lo)))::bigint as bin, count(*) as n, round(count(*) * 100.0 / max(total), 6) as percent from lat join e using (edge) group by 1, 2")
def latency_hist(spark, sf_dir):
    return mt.histogram(latencies(spark, sf_dir), ("edge",), "latency", 20).withColumn("percent", r6("percent"))


@query(f"with {EV} select seq, user_id, (row_number() over (partition by user_id order by ts, seq) - count(*) over (partition by user_id order by ts range between unbounded preceding and 86400 preceding))::bigint as in_window from ev")
def trailing_throughput(spark, sf_dir):
    return mt.trailing_throughput(transactions(spark, sf_dir), ("entity_id",), "ts", "seq", DAY).select("seq", F.col("entity_id").alias("user_id"), "in_window")


@query(f"with {MS} select edge, round(quantile_cont(latency, 0.95), 6) as observed, quantile_cont(latency, 0.95) <= 115 as met from lat group by edge")
def flow_slo(spark, sf_dir):
    return mt.flow_slo(latencies(spark, sf_dir), "edge", "latency", 0.95, 115).withColumn("observed", r6("observed"))


@query(f"with {MS} select edge, (arrival // 30 * 30)::bigint as interval_start, count(*) as messages, sum(bytes)::bigint as bytes, round(count(*) / 30.0, 6) as per_second from ms group by 1, 2")
def pipe_meter(spark, sf_dir):
    return mt.pipe_meter(messages(spark, sf_dir), "edge", "arrival", "bytes", 30).withColumn("per_second", r6("per_second"))


@query(f"with {MS}, p as (select edge, arrival, count(*) as n from ms group by all) select edge, round(avg(n), 6) as mean, round(quantile_cont(n, 0.01), 6) as p1 from p group by edge")
def sink_throughput(spark, sf_dir):
    return mt.sink_throughput(messages(spark, sf_dir), "edge", "arrival").select("edge", r6("mean").alias("mean"), r6("p1").alias("p1"))


_PRIO = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("select o_orderstatus as status, " + ", ".join(f"round(coalesce(avg(o_totalprice) filter (where o_orderpriority = '{p}'), 0), 2) as \"{p}_mean\", round(coalesce(stddev_samp(o_totalprice) filter (where o_orderpriority = '{p}'), 0), 2) as \"{p}_std\"" for p in _PRIO) + " from orders group by 1")
def mttr_pivot(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), "o_orderpriority", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    d = mt.pivot_stats(o, "status", "o_orderpriority", _PRIO, "o_totalprice")
    return d.select("status", *[F.round(F.col(f"`{p}_{s}`"), 2).alias(f"{p}_{s}") for p in _PRIO for s in ("mean", "std")])


_CELLS = [(a, b) for a in "ANR" for b in "FO"]


@query("select l_suppkey % 7 as edge, " + ", ".join(f"round(avg(l_tax * 100.0 / case when l_discount = 0 then 1 else l_discount end) filter (where l_returnflag = '{a}' and l_linestatus = '{b}'), 4) as \"{a}_{b}\"" for a, b in _CELLS) + " from lineitem group by 1")
def violation_pivot(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 7).alias("edge"), "l_returnflag", "l_linestatus", F.col("l_tax").cast("double").alias("part"), F.col("l_discount").cast("double").alias("total"))
    d = mt.pivot_percent(l, "edge", _CELLS, "l_returnflag", "l_linestatus", "part", "total")
    return d.select("edge", *[F.round(F.col("_".join(c)), 4).alias("_".join(c)) for c in _CELLS])


@query(f"with {EL}, h as (select user_id % 4 as pipe, label, count(*) as n from el group by all) select pipe, " + ", ".join(f"coalesce(sum(n) filter (where label = '{x}'), 0)::bigint as {x}" for x in ("public", "client", "audit", "internal")) + " from h group by pipe")
def label_histogram(spark, sf_dir):
    d = labelled(spark, sf_dir).groupBy((F.col("user_id") % 4).alias("pipe")).pivot("_label", ["public", "client", "audit", "internal"]).count()
    return d.na.fill(0)


@query(f"with {MS}, l as (select edge, 1.0 / greatest(1, avg(latency)) as w from lat group by edge) select edge, round(w / sum(w) over (), 6) as share from l")
def target_shares(spark, sf_dir):
    d = latencies(spark, sf_dir).groupBy("edge").agg((F.lit(1.0) / F.greatest(F.lit(1.0), F.avg("latency"))).alias("w"))
    return d.select("edge", r6(F.col("w") / F.sum("w").over(Window.partitionBy())).alias("share"))


@query(f"with {MS}, q as (select edge, unnest([0.5, 0.9, 0.95]) as p, unnest([quantile_disc(latency, 0.5), quantile_disc(latency, 0.9), quantile_disc(latency, 0.95)]) as v from lat group by edge) select edge, coalesce(arg_min(v, p) filter (where p >= 0.92), arg_max(v, p)) as latency from q group by edge")
def quantile_lookup(spark, sf_dir):
    q = lambda x: F.expr(f"percentile_disc({x}) within group (order by latency)").cast("long")
    t = latencies(spark, sf_dir).groupBy("edge").agg(*[q(x).alias(f"q{i}") for i, x in enumerate((0.5, 0.9, 0.95))])
    t = t.select("edge", F.inline(F.array(*[F.struct(F.lit(x).alias("p"), F.col(f"q{i}").alias("latency")) for i, x in enumerate((0.5, 0.9, 0.95))])))
    return mt.percentile_lookup(t, ("edge",), "p", "latency", 0.92)


@query(f"with {MS}, g as (select edge, msg % 500 as k, row_number() over (partition by msg % 500 order by arrival, msg, part) - 1 as i, arrival, msg, part from ms), f as (select *, arrival - first_value(arrival) over (partition by k order by i) as t from g), m as (select *, i + 1 + least(0, min(floor(t / 30) - i) over (partition by k order by i)) as c from f), d as (select *, lag(c, 1, 0) over (partition by k order by i) as c0 from m) select k, msg, part, arrival from d where c > c0")
def downsample(spark, sf_dir):
    d = messages(spark, sf_dir).select((F.col("msg") % 500).alias("k"), "msg", "part", "arrival")
    return mt.downsample(d.withColumn("o", F.struct("arrival", "msg", "part")), ("k",), "arrival", "o", 30).select("k", "msg", "part", "arrival")


@query("with f as (select l_orderkey as k, l_linenumber::bigint - 1 as s, min((l_shipdate::date - date '1970-01-01')::int) as a from lineitem group by 1, 2) select k, s, case when row_number() over (partition by k order by s) - 1 = s then max(a) over (partition by k order by s) end as released_at from f")
def sequence_release(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber").cast("long") - 1).alias("s"), F.unix_date(F.col("l_shipdate").cast("date")).alias("a"))
    return od.sequence_release(l, "k", "s", "a")


_W = [("public", "r0", 0.5), ("public", "r1", 0.25), ("public", "r2", 0.25), ("client", "r0", 0.75), ("client", "r1", 0.25), ("internal", "r0", 1.0)]
_PICK = "case label when 'public' then case when u < 0.5 then 'r0' when u < 0.75 then 'r1' else 'r2' end when 'client' then case when u < 0.75 then 'r0' else 'r1' end when 'internal' then 'r0' end"


@query(f"with {EL}, u as (select *, (seq * 7919 % 1000) / 1000.0 as u from el) select seq, label, {_PICK} as receiver from u")
def weighted_routing(spark, sf_dir):
    t = spark.createDataFrame(_W, "label string, receiver string, weight double")
    d = labelled(spark, sf_dir).select("seq", F.col("_label").alias("label"))
    return rt.weighted_pick(d, t, (F.col("seq") * 7919 % 1000) / 1000.0).select("seq", "label", "receiver")


_RUN = "len(list_filter(range(1, len({h}) + 1), lambda j: {h}[j].n = {first} + j - 1))"
_OUT = "list_transform({h}[1:{run}], lambda y: {{'n': y.n, 'a': y.a, 'o': 'released', 't': {t}}})"
SEQUENCED = f"""with recursive {EV},
d as (select user_id % 50 as k, row_number() over (partition by user_id % 50 order by seq) - 1 as r from ev),
e as (select k, r, b + b // 9 as n, r * 10 + r % 4 as c from (select k, r, case when r % 13 = 5 then r - 2 else xor(r, 1) end as b from d)),
l as (select k, list({{'n': n, 'a': r, 'c': c}} order by r) as e, count(*) as m from e group by k),
w as (
  select k, 0::bigint as i, 0::bigint as nxt, null::bigint as since, []::struct(n bigint, a bigint)[] as held, []::struct(n bigint, a bigint, o varchar, t bigint)[] as out from l
  union all
  select k, i, case when kind = 'dup' then nxt else first + run end as nxt,
    case when kind = 'dup' then since when len(h) = run then null when kind = 'fire' then t else coalesce(since, t) end as since,
    case when kind = 'dup' then held else h[run + 1:] end as held,
    case when kind = 'dup' then [{{'n': x.n, 'a': x.a, 'o': 'duplicate', 't': t}}]
      when kind = 'fire' then list_concat([{{'n': null::bigint, 'a': null::bigint, 'o': 'skipped', 't': t}}], {_OUT.format(h='h', run='run', t='t')})
      else list_concat(list_transform(list_filter(held, lambda y: y.n = x.n), lambda y: {{'n': y.n, 'a': y.a, 'o': 'replaced', 't': t}}), {_OUT.format(h='h', run='run', t='t')}) end as out
  from (select *, {_RUN.format(h='h', first='first')} as run from (
    select k, case when fire then i else i + 1 end as i, nxt, since, held, x, case when fire then 'fire' when x.n < nxt then 'dup' else 'offer' end as kind,
      case when fire then since + 35 else x.c end as t, case when fire then held[1].n else nxt end as first,
      case when fire then held else list_sort(list_append(list_filter(held, lambda y: y.n <> x.n), {{'n': x.n, 'a': x.a}})) end as h
    from (select w.*, e[i + 1] as x, len(held) > 0 and (i = m or since + 35 <= e[i + 1].c) as fire from w join l using (k) where i < m or len(held) > 0)))),
o as (select k, unnest(out) as r from w)
select k, r.n as n, r.a as a, r.o as outcome, r.t as at from o"""


@query(SEQUENCED)
def sequence_ports(spark, sf_dir):
    """Sequenced ports with a gap timeout over numbers that are missing, swapped and repeated; the SQL walks them by recursion."""
    d = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("k"), (F.row_number().over(Window.partitionBy(F.col("user_id") % 50).orderBy("event_id")) - 1).cast("long").alias("r"))
    b = F.when(F.col("r") % 13 == 5, F.col("r") - 2).otherwise(F.col("r").bitwiseXOR(F.lit(1).cast("long")))
    e = d.withColumn("b", b).select("k", (F.col("b") + F.expr("b div 9")).alias("n"), F.col("r").alias("a"), (F.col("r") * 10 + F.col("r") % 4).alias("c"))
    return pt.sequenced_ports(e, "k", "n", "a", "c", gap=35).select("k", F.col("seq").alias("n"), F.col("arrival").alias("a"), "outcome", "at")
