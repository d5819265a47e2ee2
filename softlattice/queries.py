"""The engine's queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import argmax, exp_scale, weight
from .functions.formula import Formula
from .operators import impact, layout, objective, reduce, schema, score
from .plans import cli, optim
from .plans.train import Model, train, train_plus
from .sources import io
from .sources.scratch import scratch

QUERIES: dict = {}
SQL: dict[str, str] = {}

ORDERS = Formula.parse("o_orderstatus ~ o_orderpriority + o_totalprice")
LINES = Formula.parse("l_returnflag ~ l_quantity + l_discount + l_tax")
EVENTS = Formula.parse("event_type ~ ^user_id")
PRIORITY = Formula.parse("o_orderstatus ~ ^o_orderpriority")
FLAGS, STATUS = ("A", "N", "R"), ("F", "O", "P")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = " ".join(sql.split())
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def beta(c: int, j: int) -> float:
    """The fixed coefficients of the scoring queries."""
    return ((c * 7 + j * 3) % 11 - 5) / 100


def lines_layout() -> layout.Layout:
    return layout.make_layout(LINES, schema.Schema(FLAGS, ("l_discount", "l_quantity", "l_tax"), {}))


def lines_x() -> list[float]:
    return [beta(c, j) for c in range(3) for j in range(4)]


def orders_layout(levels: tuple[str, ...]) -> layout.Layout:
    return layout.make_layout(ORDERS, schema.Schema(STATUS, ("o_totalprice",), {"o_orderpriority": levels}))


#: The levels of o_orderpriority.
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")

_D = lambda v: f"cast({v!r} as double)"
_SCORES = ", ".join(f"{_D(beta(c, 0))} + l_discount * {_D(beta(c, 1))} + l_quantity * {_D(beta(c, 2))} + l_tax * {_D(beta(c, 3))} as s{c}" for c in range(3))
_LINES_P = f"""z as (select *, {_SCORES} from lineitem), m as (select *, greatest(s0, s1, s2) as mx from z),
    e as (select *, exp(s0 - mx) as e0, exp(s1 - mx) as e1, exp(s2 - mx) as e2 from m),
    p as (select *, e0 / (e0 + e1 + e2) as p0, e1 / (e0 + e1 + e2) as p1, e2 / (e0 + e1 + e2) as p2 from e),
    c as (select *, case when p0 >= p1 and p0 >= p2 then 'A' when p1 >= p2 then 'N' else 'R' end as chosen, greatest(p0, p1, p2) as best from p)"""


# ---- formula -------------------------------------------------------------
@query("formula_parse", "select * from (values ('y', 'outcome'), ('a', 'inferred'), ('b', 'numeric'), ('c', 'categorical')) t(term, kind)")
def _(spark, sf):
    f = Formula.parse("y ~ a + #b + ^c + 0")
    return spark.createDataFrame([(t, f.kind(t)) for t in f.terms()], "term string, kind string")


@query("formula_terms", "select o_orderpriority, o_orderstatus, round(o_totalprice, 6) as o_totalprice from orders")
def _(spark, sf):
    df = table(spark, sf, "orders").select(*ORDERS.terms())
    return df.withColumn("o_totalprice", F.round("o_totalprice", 6))


@query("formula_describe", "select 'y ~ a + b (forced numeric) + c (forced categorical) + no intercept' as formula")
def _(spark, sf):
    return spark.createDataFrame([(str(Formula.parse("y ~ a + #b + ^c + 0")),)], "formula string")


# ---- sources -------------------------------------------------------------
@query("line_burst", "select cast(n_nationkey as varchar) as n_nationkey, n_name from nation where n_name is not null")
def _(spark, sf):
    lines = table(spark, sf, "nation").select(F.concat_ws("\t", F.col("n_nationkey").cast("string"), "n_name").alias("value"))
    return io.line_burst(lines.union(spark.range(1).select(F.lit("n_nationkey\tn_name"))), ["n_nationkey", "n_name"])


@query("memory_source", "select * from (values ('1', '0', '1'), ('1', '1', '1'), ('0', '1', '0')) t(x1, x2, y)")
def _(spark, sf):
    return io.memory_source(spark, [{"x1": 1, "x2": 0, "y": 1}, {"x1": 1, "x2": 1, "y": 1}, {"x1": 0, "x2": 1, "y": 0}])


@query("encode_state", "select n_name as state from nation")
def _(spark, sf):
    def there_and_back(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([io.decode_state(io.encode_state(x.encode())).decode() for x in b.column("n_name").to_pylist()], pa.string())], names=["state"])

    return table(spark, sf, "nation").select("n_name").mapInArrow(there_and_back, "state string")


_DRAW = "(cast('0x' || substr(md5('1:' || {0}), 1, 8) as bigint) + 0.5::double) / 4294967296.0::double"
_GAUSS = lambda key: f"sqrt(-2 * ln({_DRAW.format(chr(39) + 'r:' + chr(39) + ' || ' + key)})) * cos(2 * pi() * {_DRAW.format(chr(39) + 'a:' + chr(39) + ' || ' + key)})"


@query("gen_synthetic", f"""with rows as (select id, v, cast(floor({_DRAW.format("'v:' || v || ':' || id")} * 10) as integer) as l from range(10000) t(id), range(10) u(v)),
    effects as (select v, l, {_GAUSS("'e:' || v || ':' || l")} as e from range(10) t(v), range(10) u(l)),
    total as (select id, list(l order by r.v) as ls, sum(e) as s from rows r join effects using (v, l) group by id)
    select id, case when s + 0.5 * {_GAUSS("'n:' || id")} > 0 then '1' else '0' end as "Result", """ + ", ".join(f"'V{i}L' || ls[{i + 1}] as \"V{i}\"" for i in range(10)) + " from total")
def _(spark, sf):
    return io.gen_synthetic(spark, 10_000)


@query("read_offsets", "select cast(19 + coalesce(sum(length(n_name) + length(cast(n_nationkey as varchar)) + 2) over (order by n_nationkey rows between unbounded preceding and 1 preceding), 0) as bigint) as \"offset\", cast(n_nationkey as varchar) as n_nationkey, n_name from nation")
def _(spark, sf):
    path = scratch(spark, "lines")
    table(spark, sf, "nation").select(F.col("n_nationkey").cast("string"), "n_name").coalesce(1).orderBy(F.col("n_nationkey").cast("int")).coalesce(1).write.option("sep", "\t").option("header", True).csv(path)
    return io.read_delimited(spark, path, split_bytes=1)


# ---- filters and schema --------------------------------------------------
def _blanked(spark, sf):
    return table(spark, sf, "orders").withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 7 == 0, "").when(F.col("o_orderkey") % 11 == 0, "  ").otherwise(F.col("o_orderpriority")))


@query("complete_rows", "select o_orderkey, o_orderpriority from orders where o_orderkey % 7 <> 0 and o_orderkey % 11 <> 0 and length(trim(o_orderpriority)) > 0 and o_totalprice is not null")
def _(spark, sf):
    return schema.complete_rows(_blanked(spark, sf), ORDERS).select("o_orderkey", "o_orderpriority")


@query("infer_kinds", "select 'o_orderpriority' as variable, case when bool_and(try_cast(o_orderpriority as double) is not null) then 'numeric' else 'categorical' end as kind from orders union all select 'o_totalprice', case when bool_and(isfinite(o_totalprice)) then 'numeric' else 'categorical' end from orders")
def _(spark, sf):
    return schema.infer_kinds(table(spark, sf, "orders"), ORDERS)


@query("seed_forced", "select * from (values ('a', 'numeric'), ('b', 'categorical')) t(variable, kind)")
def _(spark, sf):
    return schema.infer_kinds(spark.createDataFrame([("1", "2", "x")], "a string, b string, y string"), Formula.parse("y ~ #a + ^b"))


@query("merge_defs", "select 'o_orderpriority' as variable, 'categorical' as kind union all select 'o_totalprice', 'numeric'")
def _(spark, sf):
    df = table(spark, sf, "orders")
    return schema.merge_kinds(schema.infer_kinds(df.where("o_orderkey % 2 = 0"), ORDERS), schema.infer_kinds(df.where("o_orderkey % 2 = 1"), ORDERS))


@query("outcome_levels", "select distinct o_orderstatus as outcome from orders where length(o_orderstatus) > 0")
def _(spark, sf):
    return schema.outcome_levels(table(spark, sf, "orders"), ORDERS)


@query("outcome_index", "select outcome, cast(row_number() over (order by outcome) - 1 as integer) as category from (select distinct o_orderstatus as outcome from orders)")
def _(spark, sf):
    return schema.outcome_index(table(spark, sf, "orders"), ORDERS)


_PART_LEVELS = "(select 'p_brand' as variable, p_brand as level, count(*) as n from part group by p_brand union all select 'p_name', p_name, count(*) from part group by p_name union all select 'p_type', p_type, count(*) from part group by p_type)"
PART = Formula.parse("p_size ~ p_brand + p_name + p_type")


def _part_levels(spark, sf):
    return schema.level_counts(table(spark, sf, "part"), PART, ["p_brand", "p_name", "p_type"])


@query("level_counts", f"select * from {_PART_LEVELS} t")
def _(spark, sf):
    return _part_levels(spark, sf)


@query("merge_levels", f"select * from {_PART_LEVELS} t")
def _(spark, sf):
    df = table(spark, sf, "part")
    half = lambda k: schema.level_counts(df.where(f"p_partkey % 2 = {k}"), PART, ["p_brand", "p_name", "p_type"])
    return schema.merge_levels(half(0), half(1))


@query("trim_stuck", "select 'p_type' as variable, p_type as level, count(*) as n from part group by p_type")
def _(spark, sf):
    df = table(spark, sf, "part").withColumn("one", F.lit("x"))
    return schema.trim_stuck(schema.level_counts(df, Formula.parse("p_size ~ one + p_type"), ["one", "p_type"]))


@query("high_card_vars", f"select variable, count(*) as n_levels from {_PART_LEVELS} t group by variable having count(*) > 20")
def _(spark, sf):
    return schema.high_card(_part_levels(spark, sf), 20)


@query("schema_scan", "select 'outcome' as kind, o_orderstatus as name from orders group by o_orderstatus union all select 'o_orderpriority', o_orderpriority from orders group by o_orderpriority union all select 'numeric', 'o_totalprice'")
def _(spark, sf):
    s = schema.schema_scan(table(spark, sf, "orders"), ORDERS).copy()
    rows = [("outcome", o) for o in s.outcomes] + [(v, x) for v, lv in s.levels.items() for x in lv] + [("numeric", v) for v in s.numeric]
    return spark.createDataFrame(rows, "kind string, name string")


@query("schema_report", "select 'outcome' || chr(9) || 'F' || chr(9) || 'O' || chr(9) || 'P' as line union all select 'categoric' || chr(9) || 'o_orderpriority' || chr(9) || string_agg(o_orderpriority, chr(9) order by o_orderpriority) from (select distinct o_orderpriority from orders) union all select 'numeric' || chr(9) || 'o_totalprice'")
def _(spark, sf):
    text = schema.schema_report(schema.schema_scan(table(spark, sf, "orders"), ORDERS))
    return spark.createDataFrame([(x,) for x in text.split("\n")], "line string")


_W = "case when l_linenumber = 3 then 'x' when l_linenumber = 4 then '0' else cast(l_linenumber as varchar(20)) end"


def _weighted(spark, sf):
    n = F.col("l_linenumber")
    return table(spark, sf, "lineitem").withColumn("w", F.when(n == 3, "x").when(n == 4, "0").otherwise(n.cast("string")))


@query("weight_col", f"select l_orderkey, l_linenumber, coalesce(try_cast({_W} as double), 1.0) as weight from lineitem")
def _(spark, sf):
    return _weighted(spark, sf).select("l_orderkey", "l_linenumber", weight("w").alias("weight"))


@query("positive_weight_filter", "select l_orderkey, l_linenumber from lineitem where l_linenumber <> 4")
def _(spark, sf):
    return schema.positive_weight(_weighted(spark, sf), "w").select("l_orderkey", "l_linenumber")


@query("known_outcome_filter", "select o_orderkey from orders where o_orderstatus in ('F', 'P')")
def _(spark, sf):
    return schema.known_outcome(table(spark, sf, "orders"), ORDERS, ("F", "P")).select("o_orderkey")


@query("stat_map", "select l_returnflag as key, sum(l_quantity) as weight, round(sum(l_quantity * l_linenumber), 4) as total from lineitem group by 1")
def _(spark, sf):
    return schema.stat_map(table(spark, sf, "lineitem"), "l_returnflag", F.col("l_linenumber"), F.col("l_quantity")).withColumn("total", F.round("total", 4))


@query("count_map", "select l_returnflag as key, sum(l_quantity) as count from lineitem group by 1")
def _(spark, sf):
    return schema.count_map(table(spark, sf, "lineitem"), "l_returnflag", F.col("l_quantity"))


@query("count_map_v", "select l_returnflag as key, sum(case when l_linestatus = 'F' then l_quantity else 0 end) as \"slot_F\", sum(case when l_linestatus = 'O' then l_quantity else 0 end) as \"slot_O\" from lineitem group by 1")
def _(spark, sf):
    return schema.count_map_v(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"], F.col("l_quantity"))


@query("sum_reducer", "select * from (select l_returnflag as key, sum(case when l_returnflag = 'A' then 0.0 else l_quantity end) as total from lineitem group by 1) where total <> 0")
def _(spark, sf):
    return schema.sum_reducer(table(spark, sf, "lineitem"), "l_returnflag", F.when(F.col("l_returnflag") == "A", 0.0).otherwise(F.col("l_quantity")))


@query("reservoir_sample", "select o_orderkey, o_orderstatus from orders order by md5(cast(o_orderkey as varchar)), o_orderkey limit 100")
def _(spark, sf):
    return schema.reservoir(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 100)


# ---- encoding ------------------------------------------------------------
_LAYOUT = "select 'o_orderpriority' as variable, 'CategoricalLevels' as kind, level, cast(1 + row_number() over (order by level) as integer) as idx from (select distinct o_orderpriority as level from orders) union all select '', 'Const', '', 0 union all select 'o_totalprice', 'Numeric', '', 1"


@query("layout", _LAYOUT)
def _(spark, sf):
    return layout.layout_table(spark, layout.make_layout(ORDERS, schema.schema_scan(table(spark, sf, "orders"), ORDERS)))


@query("enc_row", f"with l as ({_LAYOUT}) select o_orderkey, l.idx, cast(1.0 as double) as val from orders join l on l.variable = 'o_orderpriority' and l.level = o_orderpriority union all select o_orderkey, 0, 1.0 from orders union all select o_orderkey, 1, o_totalprice from orders where o_totalprice <> 0")
def _(spark, sf):
    return layout.encode_long(table(spark, sf, "orders"), orders_layout(PRIORITIES), "o_orderkey")


@query("adapt_rows", "select o_orderkey, cast(case o_orderstatus when 'F' then 0 when 'O' then 1 when 'P' then 2 else -1 end as integer) as category, cast(1.0 as double) as weight from orders where o_orderkey % 7 <> 0 and o_orderkey % 11 <> 0")
def _(spark, sf):
    return layout.encode(_blanked(spark, sf), orders_layout(PRIORITIES), keep=["o_orderkey"]).select("o_orderkey", "category", "weight")


@query("enc_numeric", "select o_orderkey, o_totalprice as val from orders where o_totalprice <> 0")
def _(spark, sf):
    return layout.encode_long(table(spark, sf, "orders"), orders_layout(PRIORITIES), "o_orderkey").where("idx = 1").select("o_orderkey", "val")


@query("enc_const", "select o_orderkey, cast(1.0 as double) as val from orders")
def _(spark, sf):
    return layout.encode_long(table(spark, sf, "orders"), orders_layout(PRIORITIES), "o_orderkey").where("idx = 0").select("o_orderkey", "val")


@query("enc_indicator", "select o_orderkey, cast(1 + cast(substr(o_orderpriority, 1, 1) as integer) as integer) as idx from orders")
def _(spark, sf):
    return layout.encode_long(table(spark, sf, "orders"), orders_layout(PRIORITIES), "o_orderkey").where("idx > 1").select("o_orderkey", "idx")


def _coded() -> layout.Layout:
    codes = {p: (i + 0.5, 2.0 - i) for i, p in enumerate(PRIORITIES[:4])}
    return layout.make_layout(ORDERS, schema.Schema(STATUS, ("o_totalprice",), {"o_orderpriority": PRIORITIES}), {"o_orderpriority": (("u", "v"), codes)})


_CODES = "(values ('1-URGENT', 0.5, 2.0), ('2-HIGH', 1.5, 1.0), ('3-MEDIUM', 2.5, 0.0), ('4-NOT SPECIFIED', 3.5, -1.0)) c(level, u, v)"


@query("enc_level_vector", f"select o_orderkey, cast(coalesce(u, 0) as double) as u, cast(coalesce(v, 0) as double) as v from orders left join {_CODES} on level = o_orderpriority")
def _(spark, sf):
    return layout.encode(table(spark, sf, "orders"), _coded(), keep=["o_orderkey"]).select("o_orderkey", F.get("num", F.lit(2)).alias("u"), F.get("num", F.lit(3)).alias("v"))


@query("category_of", "select distinct o_orderstatus, cast(case o_orderstatus when 'F' then 0 when 'O' then 1 when 'P' then 2 else -1 end as integer) as category from orders")
def _(spark, sf):
    return layout.encode(table(spark, sf, "orders"), orders_layout(PRIORITIES), keep=["o_orderstatus"]).select("o_orderstatus", "category").distinct()


def _coded_x() -> list[float]:
    return [beta(c, j) for c in range(3) for j in range(4)]


@query("effects", f"select 'o_orderpriority' as variable, k as category, level, round(u * {_D(0.01)} * (((k * 7 + 6) % 11) - 5) + v * {_D(0.01)} * (((k * 7 + 9) % 11) - 5), 6) as effect from {_CODES}, (values (0), (1), (2)) t(k)")
def _(spark, sf):
    rows = [(v, c, lv, round(e, 6)) for v, c, lv, e in layout.effects(_coded(), _coded_x()) if v == "o_orderpriority"]
    return spark.createDataFrame(rows, "variable string, category int, level string, effect double")


@query("detailed_effects", f"select level || '_u' as level, k as category, round(u * {_D(0.01)} * (((k * 7 + 6) % 11) - 5), 6) as effect from {_CODES}, (values (0), (1), (2)) t(k) union all select level || '_v', k, round(v * {_D(0.01)} * (((k * 7 + 9) % 11) - 5), 6) from {_CODES}, (values (0), (1), (2)) t(k) union all select level || '_effect', k, round(u * {_D(0.01)} * (((k * 7 + 6) % 11) - 5) + v * {_D(0.01)} * (((k * 7 + 9) % 11) - 5), 6) from {_CODES}, (values (0), (1), (2)) t(k)")
def _(spark, sf):
    rows = [(lv, c, round(e, 6)) for v, c, lv, e in layout.effects(_coded(), _coded_x(), detailed=True) if v == "o_orderpriority"]
    return spark.createDataFrame(rows, "level string, category int, effect double")


@query("effect_of_level", f"select cast({_D(0.02)} * 7.5 as double) as numeric_effect, round(0.5 * {_D(0.01)} + 2.0 * {_D(0.04)}, 6) as level_effect, cast(0.0 as double) as unknown_effect")
def _(spark, sf):
    lay, x = _coded(), [0.0, 0.02, 0.01, 0.04] + [0.0] * 8
    at = lambda v, value: round(layout.effect_of(lay, x, v, value), 6)
    return spark.createDataFrame([(at("o_totalprice", "7.5"), at("o_orderpriority", "1-URGENT"), at("o_orderpriority", "none"))], "numeric_effect double, level_effect double, unknown_effect double")


_SOLUTION = f"""with v as (select * from (values ('', 'Const', '', 0), ('l_discount', 'Numeric', '', 1), ('l_quantity', 'Numeric', '', 2), ('l_tax', 'Numeric', '', 3)) t(variable, kind, level, j)),
    o as (select * from (values ('A', 0), ('N', 1), ('R', 2)) t(outcome, outcomegroup))
    select outcome, outcomegroup, variable, kind, level, round((((outcomegroup * 7 + j * 3) % 11) - 5) * {_D(0.01)}, 6) as value from o, v"""


@query("format_solution", _SOLUTION)
def _(spark, sf):
    return layout.format_solution(spark, lines_layout(), lines_x()).withColumn("value", F.round("value", 6))


@query("decode_solution", f"select outcome, variable, value from ({_SOLUTION}) s order by outcome, variable")
def _(spark, sf):
    return layout.format_solution(spark, lines_layout(), lines_x()).select("outcome", "variable", F.round("value", 6).alias("value")).orderBy("outcome", "variable")


@query("save_model", f"select outcome, variable, value from ({_SOLUTION}) s")
def _(spark, sf):
    path = scratch(spark, "model")
    io.save_model(spark, Model(lines_layout(), np.array(lines_x())), path)
    m = io.load_model(spark, path)
    return layout.format_solution(spark, m.layout, m.x).select("outcome", "variable", F.round("value", 6).alias("value"))


# ---- objective -----------------------------------------------------------
def _eval_rows(spark, e: objective.Eval) -> DataFrame:
    n = len(e.g)
    rows = [("f", 0, 0, round(e.f, 3))] + [("g", i, 0, round(float(e.g[i]), 3)) for i in range(n)] + [("h", i, j, round(float(e.h[i, j]), 2)) for i in range(n) for j in range(n)]
    return spark.createDataFrame(rows, "part string, i int, j int, value double")


_X = ("cast(1.0 as double)", "l_discount", "l_quantity", "l_tax")
_F = f"with {_LINES_P}, q as (select *, (l_returnflag = 'A')::int as y0, (l_returnflag = 'N')::int as y1, (l_returnflag = 'R')::int as y2 from c)"
_EVAL = f"{_F} select 'f' as part, 0 as i, 0 as j, round(sum(y0 * ln(p0) + y1 * ln(p1) + y2 * ln(p2)), 3) as value from q " + " ".join(
    f"union all select 'g', {c * 4 + j}, 0, round(sum({_X[j]} * (y{c} - p{c})), 3) from q" for c in range(3) for j in range(4)
) + " " + " ".join(f"union all select 'h', {a * 4 + i}, {b * 4 + j}, round(-sum({_X[i]} * {_X[j]} * p{a} * ({int(a == b)} - p{b})), 2) from q" for a in range(3) for b in range(3) for i in range(4) for j in range(4))


@query("loss_eval", _EVAL)
def _(spark, sf):
    lay = lines_layout()
    return _eval_rows(spark, objective.DataObjective(layout.encode(table(spark, sf, "lineitem"), lay), lay)(np.array(lines_x())))


@query("eval_add", _EVAL)
def _(spark, sf):
    lay, df = lines_layout(), layout.encode(table(spark, sf, "lineitem").withColumn("_k", F.col("l_orderkey") % 2), lines_layout(), keep=["_k"])
    half = lambda k: objective.DataObjective(df.where(F.col("_k") == k), lay)(np.array(lines_x()))
    return _eval_rows(spark, half(0) + half(1))


@query("norm_penalty", "select cast(-0.02 * (0.25 + 0.09 + 4) as double) as f, cast(-0.02 as double) as g0, cast(-0.04 as double) as h11, cast(-0.02 * (0.25 + 4) as double) as f_masked, cast(0 as double) as g1_masked")
def _(spark, sf):
    x = np.array([0.5, -0.3, 2.0])
    e, m = objective.NormPenalty(3, 2e-2)(x), objective.NormPenalty(3, 2e-2, np.array([1, 0, 1]))(x)
    row = [round(float(v), 9) + 0.0 for v in (e.f, e.g[0], e.h[1, 1], m.f, m.g[1])]
    return spark.createDataFrame([tuple(row)], "f double, g0 double, h11 double, f_masked double, g1_masked double")


@query("eval_read", _EVAL)
def _(spark, sf):
    lay, x = lines_layout(), np.array(lines_x())
    e = objective.DataObjective(layout.encode(table(spark, sf, "lineitem"), lay), lay)(x)
    return _eval_rows(spark, objective.Eval.unpack(x, np.array(io.read_vec(io.write_vec(e.pack()))), True, True))


@query("sum_fn", f"{_F} select round(sum(y0 * ln(p0) + y1 * ln(p1) + y2 * ln(p2)) - 0.5 * " + " - 0.5 * ".join(f"{_D(beta(c, j) ** 2)}" for c in range(3) for j in range(4)) + ", 3) as f from q")
def _(spark, sf):
    lay = lines_layout()
    both = objective.SumFn(objective.DataObjective(layout.encode(table(spark, sf, "lineitem"), lay), lay), objective.NormPenalty(lay.dims, 0.5))
    return spark.createDataFrame([(round(both(np.array(lines_x()), False, False).f, 3),)], "f double")


_TAX = "(-40 * l_tax / ln(2.0))"


@query("fast_exp", f"select l_orderkey, l_linenumber, round(pow(2, floor({_TAX})) * (1 + {_TAX} - floor({_TAX})), 6) as e from lineitem")
def _(spark, sf):
    def run(batches):
        for b in batches:
            e = objective.fast_exp(-40 * b.column("l_tax").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column("l_orderkey"), b.column("l_linenumber"), pa.array(e)], names=["l_orderkey", "l_linenumber", "e"])

    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_tax").mapInArrow(run, "l_orderkey long, l_linenumber int, e double")
    return rows.withColumn("e", F.round("e", 6))


@query("reduce_parallel", "select l_returnflag as flag, count(*) as n, max(l_extendedprice) as most from lineitem group by l_returnflag")
def _(spark, sf):
    def join(a, b):
        return {f: (a.get(f, (0, 0.0))[0] + b.get(f, (0, 0.0))[0], max(x[f][1] for x in (a, b) if f in x)) for f in a.keys() | b.keys()}

    def observe(state, batch):
        by = pa.Table.from_batches([batch]).group_by("l_returnflag").aggregate([("l_extendedprice", "max"), ("l_extendedprice", "count")]).to_pylist()
        return join(state, {r["l_returnflag"]: (r["l_extendedprice_count"], r["l_extendedprice_max"]) for r in by})

    found = reduce.reduce_parallel(table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice"), dict, observe, join)
    return spark.createDataFrame([(f, n, most) for f, (n, most) in sorted(found.items())], "flag string, n long, most double")


@query("exp_scale", "select l_orderkey, l_linenumber, round(exp(l_tax) / (exp(l_tax) + exp(l_discount)), 6) as p from lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.get(exp_scale(F.array("l_tax", "l_discount")), F.lit(0)), 6).alias("p"))


# ---- scoring -------------------------------------------------------------
def _scored(spark, sf) -> DataFrame:
    return score.score(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *LINES.terms()), lines_layout(), lines_x())


@query("predict", f"with {_LINES_P} select l_orderkey, l_linenumber, round(p0, 6) as p0, round(p1, 6) as p1, round(p2, 6) as p2 from p")
def _(spark, sf):
    p = score.predict(table(spark, sf, "lineitem"), lines_layout(), lines_x())
    return p.select("l_orderkey", "l_linenumber", *[F.round(F.get("_p", F.lit(i)), 6).alias(f"p{i}") for i in range(3)])


@query("score", f"with {_LINES_P} select l_orderkey, l_linenumber, l_returnflag, round(p0, 6) as p_a, round(p1, 6) as p_n, round(p2, 6) as p_r, chosen, round(best, 6) as best from c")
def _(spark, sf):
    p = [F.round(F.col(f"`model.predict.l_returnflag.{o}`"), 6).alias(f"p_{o.lower()}") for o in FLAGS]
    return _scored(spark, sf).select("l_orderkey", "l_linenumber", "l_returnflag", *p, F.col("`model.chosen.Outcome`").alias("chosen"), F.round(F.col("`model.predict.Outcome`"), 6).alias("best"))


@query("write_scored_tsv", f"with {_LINES_P} select l_returnflag, chosen, coalesce(comment, '') as comment, count(*) as n, round(avg(best), 6) as mean_best from (select *, case when l_linenumber > 1 then 'x' end as comment from c) t group by 1, 2, 3")
def _(spark, sf):
    path = scratch(spark, "scored")
    rows = table(spark, sf, "lineitem").select(*LINES.terms(), F.when(F.col("l_linenumber") > 1, "x").alias("comment"))
    io.write_scored(rows, Model(lines_layout(), np.array(lines_x())), path)
    back = spark.read.option("sep", "\t").option("header", True).option("nullValue", "\u0000").option("emptyValue", "").csv(path)
    best = F.round(F.avg(F.col("`model.predict.Outcome`").cast("double")), 6).alias("mean_best")
    return back.groupBy("l_returnflag", F.col("`model.chosen.Outcome`").alias("chosen"), F.coalesce("comment", F.lit("")).alias("comment")).agg(F.count("*").alias("n"), best)


@query("score_mr", f"with {_LINES_P} select 'Offset.' || case when l_linenumber = 1 then cast(1234567890000 + l_orderkey as varchar) else lpad(cast(l_orderkey * 10 + l_linenumber as varchar), 12, '0') end as \"File.Offset\", chosen, round(best, 6) as best from c")
def _(spark, sf):
    n = F.col("l_linenumber")
    df = table(spark, sf, "lineitem").select(F.when(n == 1, F.col("l_orderkey") + 1234567890000).otherwise(F.col("l_orderkey") * 10 + n).alias("k"), *LINES.terms())
    s = score.score_by_key(df, lines_layout(), lines_x(), "k")
    return s.select("`File.Offset`", F.col("`predict.l_returnflag`").alias("chosen"), F.round(F.col("`predict.l_returnflag.score`"), 6).alias("best"))


@query("argmax", "select l_orderkey, l_linenumber, cast(case when l_tax >= l_discount then 0 else 1 end as integer) as k from lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", argmax(F.array("l_tax", "l_discount")).alias("k"))


@query("accuracy", f"with {_LINES_P} select count(*) filter (chosen = l_returnflag) as n_right, count(*) as n, round(avg((chosen = l_returnflag)::int), 6) as accuracy from c")
def _(spark, sf):
    return score.accuracy(_scored(spark, sf), lines_layout()).withColumn("accuracy", F.round("accuracy", 6))


@query("accuracy_mr", f"with {_LINES_P} select count(*) filter (chosen = l_returnflag) as n_right, count(*) as n, round(avg((chosen = l_returnflag)::int), 6) as accuracy from c where l_linenumber > 2")
def _(spark, sf):
    df = table(spark, sf, "lineitem").select((F.col("l_linenumber") - 2).alias("w"), *LINES.terms())
    return score.accuracy(score.score(df, lines_layout(), lines_x()), lines_layout(), "w").withColumn("accuracy", F.round("accuracy", 6))


_CONFUSION = f"with {_LINES_P}, o as (select * from (values ('A'), ('N'), ('R')) t(o)) select a.o as predicted, b.o as actual, (select count(*) from c where chosen = a.o and l_returnflag = b.o) as n from o a, o b"


@query("confusion_matrix", _CONFUSION)
def _(spark, sf):
    return score.confusion_matrix(_scored(spark, sf), lines_layout())


@query("scored_marginals", f"with {_LINES_P} select chosen as predicted, l_returnflag as actual, count(*) as n from c group by 1, 2")
def _(spark, sf):
    return score.marginals(_scored(spark, sf), lines_layout())


# ---- impact codes --------------------------------------------------------
_STATS = """with k as (select count(distinct event_type) as k, count(*) as total from events), t as (select event_type as outcome, count(*) as tc from events group by 1),
    u as (select cast(user_id as varchar) as level, count(*) as n from events group by 1), x as (select cast(user_id as varchar) as level, event_type as outcome, count(*) as nc from events group by 1, 2),
    s as (select u.level, t.outcome, cast(u.n as double) as n, cast(coalesce(x.nc, 0) as double) as nc, cast(t.tc as double) as tc, cast(k.total as double) as total, cast(k.k as double) as k
    from u cross join t cross join k left join x on x.level = u.level and x.outcome = t.outcome)"""


def _events_stats(spark, sf):
    df = table(spark, sf, "events")
    s = schema.schema_scan(df, EVENTS)
    return impact.impact_stats(df, layout.make_layout(EVENTS, s), ["user_id"])


@query("impact_stats", f"{_STATS} select 'user_id' as variable, level, outcome, n, nc, round(n / k, 6) as p, round(k * nc - (n - nc) * k / (k - 1), 6) as r, round(k * nc, 6) as rc, round(nc / k, 6) as pc from s")
def _(spark, sf):
    return _events_stats(spark, sf).select("variable", "level", "outcome", "n", "nc", *[F.round(c, 6).alias(c) for c in ("p", "r", "rc", "pc")])


@query("impact_merge", f"{_STATS} select 'user_id' as variable, level, outcome, n, nc, round(n / k, 6) as p, round(k * nc - (n - nc) * k / (k - 1), 6) as r, round(k * nc, 6) as rc, round(nc / k, 6) as pc, tc as outcome_weight, total as total_weight from s")
def _(spark, sf):
    df = table(spark, sf, "events")
    lay = layout.make_layout(EVENTS, schema.schema_scan(df, EVENTS))
    part = lambda k: impact.impact_stats(df.where(F.col("event_id") % 3 == k), lay, ["user_id"])
    merged = impact.merge_stats(impact.merge_stats(part(0), part(1)), part(2))
    return merged.select("variable", "level", "outcome", "n", "nc", *[F.round(c, 6).alias(c) for c in ("p", "r", "rc", "pc")], "outcome_weight", "total_weight")


_CODE = {
    "logbayes": "ln((total + 0.5) * (nc + 0.5) / ((tc + 0.5) * (n + 0.5)))", "runTerm": "(k * nc + 0.5) / (nc + 0.5)", "logRunTerm": "ln((k * nc + 0.5) / (nc + 0.5))",
    "runTermF": "(k * nc - (n - nc) * k / (k - 1) + 0.5) / (n + 0.5)", "balance": "(nc - n / k) / (n + 0.5)", "balanceLR": "ln((nc + 0.5) / (n / k + 0.5))",
    "superBalance": "(nc - nc / k) / (n + 0.5)", "superBalanceLR": "ln((nc + 0.5) / (nc / k + 0.5))",
}
_ALL_CODES = " union all ".join(f"select level, outcome, '{c}' as code, round({e}, 6) as value from s" for c, e in _CODE.items())


@query("impact_codes", f"{_STATS} {_ALL_CODES}")
def _(spark, sf):
    codes = impact.impact_codes(_events_stats(spark, sf)).where("code <> 'logRunTermF'")
    return codes.select("level", "outcome", "code", (F.round("value", 6) + 0.0).alias("value"))


@query("effect_term", f"{_STATS} select level, outcome, round(case when cast(level as integer) % 2 = 0 then nc / 10 else 0 end, 6) as value from s")
def _(spark, sf):
    stats = _events_stats(spark, sf)
    effect = stats.where(F.col("level").cast("int") % 2 == 0).select("variable", "level", "outcome", (F.col("nc") / 10).alias("effect"))
    return impact.impact_codes(stats, effect).where("code = 'effectTerm'").select("level", "outcome", F.round("value", 6).alias("value"))


@query("print_codes", f"{_STATS} select 'user_id' || chr(9) || level || chr(9) || outcome || chr(9) || 'n' || chr(9) || cast(cast(n as integer) as varchar) as line from s order by level, outcome limit 40")
def _(spark, sf):
    codes = _events_stats(spark, sf).select("variable", "level", "outcome", F.lit("n").alias("code"), F.col("n").cast("int").alias("value"))
    lines = impact.print_codes(codes, 40).split("\n")
    return spark.createDataFrame([(x,) for x in lines[1:]], "line string")


@query("impact_code_filter", f"{_STATS}, c as ({_ALL_CODES} union all select level, outcome, 'logRunTermF', case when min({_CODE['runTermF']}) over (partition by outcome) > 0 then ln(greatest({_CODE['runTermF']}, 1e-300)) end from s) select outcome, code, count(*) as n from c group by 1, 2 having count(value) = count(*) and sum(value * value) > 1e-12")
def _(spark, sf):
    return impact.impact_code_filter(impact.impact_codes(_events_stats(spark, sf))).groupBy("outcome", "code").agg(F.count("*").alias("n"))


@query("translate_solution", f"select k as category, level, round(u * {_D(0.01)} * (((k * 7 + 6) % 11) - 5) + v * {_D(0.01)} * (((k * 7 + 9) % 11) - 5), 6) as value from (select * from {_CODES} union all select '5-LOW', 0, 0) z, (values (0), (1), (2)) t(k)")
def _(spark, sf):
    plain = orders_layout(PRIORITIES)
    x = impact.translate(_coded(), _coded_x(), plain)
    rows = [(c, n, round(x[c * plain.width + 2 + i], 6)) for c in range(3) for i, n in enumerate(PRIORITIES)]
    return spark.createDataFrame(rows, "category int, level string, value double")


_KEPT = f"{_STATS}, c as ({_ALL_CODES} union all select level, outcome, 'logRunTermF', case when min({_CODE['runTermF']}) over (partition by outcome) > 0 then ln(greatest({_CODE['runTermF']}, 1e-300)) end from s), kept as (select outcome, code from c group by 1, 2 having count(value) = count(*) and sum(value * value) > 1e-12)"
_ORDER = "case code " + " ".join(f"when '{c}' then {n}" for n, c in enumerate(impact.CODES)) + " end"


@query("impact_recode", f"{_KEPT} select 'user_id' as variable, 'CategoricalVectorEnc' as kind, code || '_' || outcome as level, cast(row_number() over (order by outcome, {_ORDER}) as integer) as idx from kept union all select '', 'Const', '', 0")
def _(spark, sf):
    df = table(spark, sf, "events")
    s = schema.schema_scan(df, EVENTS, most=100)
    stats = impact.impact_stats(df, layout.make_layout(EVENTS, s), ["user_id"])
    return layout.layout_table(spark, layout.make_layout(EVENTS, s, impact.code_tables(stats, s.outcomes)))


@query("warm_start", f"""select outcome, outcomegroup, variable, kind, level, cast(case level when 'effectTerm_F' then (outcomegroup = 0)::int when 'logbayes_F' then 0 else ((j * 3 + outcomegroup * 21) % 11 - 5) / 100.0 end as double) as value
    from (values ('F', 0), ('O', 1), ('P', 2)) o(outcome, outcomegroup), (values ('', 'Const', '', 0), ('o_totalprice', 'Numeric', '', 1), ('o_orderpriority', 'CategoricalVectorEnc', 'effectTerm_F', 2), ('o_orderpriority', 'CategoricalVectorEnc', 'logbayes_F', 3)) v(variable, kind, level, j)""")
def _(spark, sf):
    old = orders_layout(PRIORITIES)
    codes = {p: (float(i), 1.0) for i, p in enumerate(PRIORITIES)}
    new = layout.make_layout(ORDERS, schema.Schema(STATUS, ("o_totalprice",), {"o_orderpriority": PRIORITIES}), {"o_orderpriority": (("effectTerm_F", "logbayes_F"), codes)})
    x = impact.warm_start(old, [beta(0, j) for j in range(old.dims)], new)
    return layout.format_solution(spark, new, x).withColumn("value", F.round("value", 6))


# ---- training ------------------------------------------------------------
_SHARE = "select o_orderpriority, o_orderstatus as outcome, round(count(*) / sum(count(*)) over (partition by o_orderpriority), 5) as p from orders group by 1, 2"


def _fitted(spark, sf, m: Model) -> DataFrame:
    levels = table(spark, sf, "orders").select("o_orderpriority").distinct()
    p = score.predict(levels, m.layout, m.x)
    each = F.explode(F.array(*[F.struct(F.lit(o).alias("outcome"), F.round(F.get("_p", F.lit(i)), 5).alias("p")) for i, o in enumerate(m.layout.outcomes)])).alias("e")
    return p.select("o_orderpriority", each).select("o_orderpriority", "e.outcome", "e.p")


@query("train", _SHARE)
def _(spark, sf):
    return _fitted(spark, sf, train(table(spark, sf, "orders"), PRIORITY))


@query("train_plus", "select count(*) as n, true as near_the_best from events")
def _(spark, sf):
    """No model of user_id alone beats the most frequent outcome of each user; the fit comes within a twentieth of it."""
    df = table(spark, sf, "events")
    m = train_plus(df, EVENTS, max_levels=40, passes=2, max_rounds=8)
    got = score.accuracy(score.score(df.select("user_id", "event_type"), m.layout, m.x), m.layout)
    best = df.groupBy("user_id", "event_type").count().groupBy("user_id").agg(F.max("count").alias("most")).agg(F.sum("most").alias("most"))
    return got.crossJoin(F.broadcast(best)).select("n", (F.col("n_right") >= 0.95 * F.col("most")).alias("near_the_best"))


@query("score_job", "with s as (select lang, avg(quality) as p from documents join labels using (doc_id) group by lang) select doc_id, lang, round(p, 3) as p1, case when p > 0.5 then '1' else '0' end as chosen from documents join s using (lang)")
def _(spark, sf):
    """Fits `quality ~ lang` on the labelled documents, saves the model, loads it and scores every document."""
    docs, path = table(spark, sf, "documents").select("doc_id", "lang"), scratch(spark, "model")
    io.save_model(spark, train(docs.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id"), "quality ~ ^lang", strength=1e-7, max_rounds=30), path)
    m = io.load_model(spark, path)
    s = score.score(docs, m.layout, m.x)
    return s.select("doc_id", "lang", F.round(F.col("`model.predict.quality.1`"), 3).alias("p1"), F.col("`model.chosen.Outcome`").alias("chosen"))


@query("train_job", "select count(*) as n, true as same_accuracy from orders")
def _(spark, sf):
    """Delimited rows in, schema, fit, saved model, accuracy on the rows: what the command line's `fit` and `apply` do."""
    data, model, out = (scratch(spark, x) for x in ("data", "model", "out"))
    table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority").write.option("sep", "\t").option("header", True).csv(data)
    got = cli.fit_job(spark, cli.parse(["fit", "--data", data, "--formula", str("o_orderstatus ~ ^o_orderpriority"), "--model", model]))
    again = cli.apply_job(spark, cli.parse(["apply", "--data", data, "--model", model, "--out", out]))
    n = spark.read.option("sep", "\t").option("header", True).csv(out).count()
    return spark.createDataFrame([(n, abs(got - again) < 1e-12)], "n long, same_accuracy boolean")


@query("solve", "select cast(0.090909 as double) as x0, cast(0.636364 as double) as x1, 4 as n_solvers")
def _(spark, sf):
    a, b = np.array([[4.0, 1.0], [1.0, 3.0]]), np.array([1.0, 2.0])
    got = [optim.solve_default(a, b), optim.solve_direct(a, b), optim.solve_cholesky(a, b), optim.solve_cg(a, b)]
    same = sum(np.abs(g - got[0]).max() < 1e-6 for g in got)
    return spark.createDataFrame([(round(float(got[0][0]), 6), round(float(got[0][1]), 6), int(same))], "x0 double, x1 double, n_solvers int")


@query("optimisers", "select method, cast(x as double) as x from (values ('newton', 1.7), ('cg', 1.7), ('gradient', 1.7), ('line_max', 1.7), ('line_min', 1.7), ('minimised', 1.7), ('halved', 1.0)) t(method, x)")
def _(spark, sf):
    bowl = lambda x, grad=True, hess=True: objective.Eval(x, float(-((x - 1.7) ** 2).sum()), -2 * (x - 1.7), -2 * np.eye(len(x)))
    cup = lambda x, grad=True, hess=True: objective.Eval(x, float(((x - 1.7) ** 2).sum()), 2 * (x - 1.7), 2 * np.eye(len(x)))
    # Its curvature is told four times too small, so that whole steps go too far and are halved.
    flat = lambda x, grad=True, hess=True: objective.Eval(x, float(-((x - 1.0) ** 2).sum()), -2 * (x - 1.0), -0.5 * np.eye(len(x)))
    one = np.zeros(1)
    got = [
        ("newton", optim.newton(bowl, one).x[0]), ("cg", optim.conjugate_gradient(bowl, one).x[0]), ("gradient", optim.gradient_ascent(bowl, one).x[0]),
        ("line_max", optim.line_max(lambda t: -((t - 1.7) ** 2), 0.0, 0.1)), ("line_min", optim.line_min(lambda t: (t - 1.7) ** 2, 0.0, 0.1)),
        ("minimised", optim.newton(optim.minimised(cup), one).x[0]), ("halved", optim.newton(flat, one).x[0]),
    ]
    return spark.createDataFrame([(k, round(float(v), 1)) for k, v in got], "method string, x double")


assert math.isclose(beta(0, 0), -0.05)
