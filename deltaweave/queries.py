"""The registered queries over the reference's own operators, each with the same query in SQL.

Money is held in whole cents, so sums do not depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.aggregates import agg_avg, agg_count, agg_max, agg_min, agg_sum, agg_xor
from .operators import replay
from .operators.zset import W, ZSet
from .plans.circuit import Plan, run

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> ZSet:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return ZSet.of(df.select(*cols) if cols else df)


def cents(c: str):
    return F.round(F.col(c) * 100).cast("long")


# -- rows


@query("SELECT o_custkey, o_orderstatus FROM orders")
def project_bag(spark, sf_dir):
    return table(spark, sf_dir, "orders").project(["o_custkey", "o_orderstatus"]).rows()


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_quantity >= 45 OR l_discount < 0.01) AND NOT (l_returnflag = 'R')")
def filter_pred(spark, sf_dir):
    keep = ((F.col("l_quantity") >= 45) | (F.col("l_discount") < 0.01)) & ~(F.col("l_returnflag") == "R")
    return table(spark, sf_dir, "lineitem").filter(keep).project(["l_orderkey", "l_linenumber", "l_quantity"]).rows()


MAP_ARITH = """
src := source("lineitem")
src :: stream(struct("l_orderkey": i64, "l_linenumber": i64, "l_partkey": i64, "l_suppkey": i64))
f :: function((struct("l_orderkey": i64, "l_linenumber": i64, "l_partkey": i64, "l_suppkey": i64)) -> struct("k": i64, "n": i64, "sum": i64, "dif": i64, "prod": i64, "quo": i64, "rem": i64))
f := function((r) -> struct("k": r.l_orderkey, "n": r.l_linenumber, "sum": r.l_partkey + r.l_suppkey, "dif": r.l_suppkey - r.l_partkey,
    "prod": r.l_partkey * r.l_suppkey, "quo": (r.l_suppkey - r.l_partkey) / (r.l_linenumber - off(r)), "rem": (r.l_suppkey - r.l_partkey) % (r.l_linenumber - off(r))))
off :: function((struct("l_orderkey": i64, "l_linenumber": i64, "l_partkey": i64, "l_suppkey": i64)) -> i64)
off := function((r) -> std.sign_i64(r.l_linenumber))
out := map(src, f)
"""


@query(
    """SELECT l_orderkey AS k, l_linenumber::BIGINT AS n, l_partkey + l_suppkey AS sum, l_suppkey - l_partkey AS dif, l_partkey * l_suppkey AS prod,
       ((l_suppkey - l_partkey) // (l_linenumber - 1))::BIGINT AS quo, ((l_suppkey - l_partkey) % (l_linenumber - 1))::BIGINT AS rem
       FROM lineitem WHERE l_linenumber <> 1"""
)
def map_arith(spark, sf_dir):
    return run(spark, MAP_ARITH, {"lineitem": spark.read.parquet(f"{sf_dir}/lineitem.parquet")}, "out")


MAP_STRING = """
src := source("customer")
src :: stream(struct("c_custkey": i64, "c_name": string("UTF-8"), "c_mktsegment": string("UTF-8")))
f :: function((struct("c_custkey": i64, "c_name": string("UTF-8"), "c_mktsegment": string("UTF-8"))) -> struct("k": i64, "u": string("UTF-8"), "l": string("UTF-8"), "n": integer, "c": string("UTF-8"), "s": string("UTF-8"), "b": enum("false","true")))
f := function((r) -> struct("k": r.c_custkey, "u": std.string_upper(r.c_name), "l": std.string_lower(r.c_mktsegment), "n": std.string_length(r.c_name),
    "c": r.c_name ++ "/" ++ r.c_mktsegment, "s": std.string_replace(r.c_name[0:8], from: "#", to: "-"), "b": std.string_contains(r.c_mktsegment, sub: "A")))
out := map(src, f)
"""


@query(
    """SELECT c_custkey AS k, upper(c_name) AS u, lower(c_mktsegment) AS l, length(c_name)::BIGINT AS n, c_name || '/' || c_mktsegment AS c,
       replace(substr(c_name, 1, 8), '#', '-') AS s, contains(c_mktsegment, 'A') AS b FROM customer"""
)
def map_string(spark, sf_dir):
    out = run(spark, MAP_STRING, {"customer": spark.read.parquet(f"{sf_dir}/customer.parquet")}, "out")
    return out.withColumn("n", F.col("n").cast("long"))


@query("SELECT event_id, unnest(string_split(event_type, 'i')) AS part FROM events")
def flat_map_unnest(spark, sf_dir):
    parts = F.transform(F.split("event_type", "i"), lambda p: F.struct(F.col("event_id").alias("event_id"), p.alias("part")))
    return table(spark, sf_dir, "events", "event_id", "event_type").flat_map(parts).rows()


# -- joins


@query(
    """SELECT c_custkey, c_name, o_orderkey, o_orderstatus FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'"""
)
def join_inner(spark, sf_dir):
    c = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment").filter(F.col("c_mktsegment") == "BUILDING").project(["c_custkey", "c_name"])
    o = table(spark, sf_dir, "orders").map({"c_custkey": F.col("o_custkey"), "o_orderkey": F.col("o_orderkey"), "o_orderstatus": F.col("o_orderstatus")})
    return c.join(o, ["c_custkey"]).rows()


@query(
    """SELECT a.l_orderkey, a.l_suppkey, a.l_linenumber, b.n::BIGINT AS n
       FROM lineitem a JOIN (SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) b USING (l_orderkey, l_suppkey)"""
)
def join_multi_key(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_linenumber")
    b = a.aggregate({"n": agg_count()}, ["l_orderkey", "l_suppkey"])
    return a.join(b, ["l_orderkey", "l_suppkey"]).rows()


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def join_cross(spark, sf_dir):
    return table(spark, sf_dir, "nation", "n_name").join(table(spark, sf_dir, "region", "r_name"), []).rows()


@query("SELECT a.n_regionkey, a.n_name AS n1, b.n_name AS n2 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey")
def join_self_theta(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    side = lambda i: n.map({"n_regionkey": F.col("n_regionkey"), f"k{i}": F.col("n_nationkey"), f"n{i}": F.col("n_name")})
    return side(1).join(side(2), ["n_regionkey"]).filter(F.col("k1") < F.col("k2")).project(["n_regionkey", "n1", "n2"]).rows()


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 200000)")
def antijoin_not_exists(spark, sf_dir):
    big = table(spark, sf_dir, "orders").filter((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 200000)).map({"c_custkey": F.col("o_custkey")})
    return table(spark, sf_dir, "customer", "c_custkey", "c_name").antijoin(big, ["c_custkey"]).rows()


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 200000)")
def semi_join(spark, sf_dir):
    big = table(spark, sf_dir, "orders").filter((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 200000)).map({"c_custkey": F.col("o_custkey")})
    return table(spark, sf_dir, "customer", "c_custkey", "c_name").semijoin(big, ["c_custkey"]).rows()


# -- sets


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem")
def distinct_rows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus", "l_quantity").distinct().rows()


def _keys(spark, sf_dir) -> tuple[ZSet, ZSet]:
    o = table(spark, sf_dir, "orders", "o_custkey").map({"k": F.col("o_custkey")})
    c = table(spark, sf_dir, "customer", "c_custkey").map({"k": F.col("c_custkey") * 2})
    return o, c


@query("SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey * 2 FROM customer")
def union_all(spark, sf_dir):
    o, c = _keys(spark, sf_dir)
    return o.plus(c).rows()


@query("SELECT o_custkey AS k FROM orders UNION SELECT c_custkey * 2 FROM customer")
def union_set(spark, sf_dir):
    o, c = _keys(spark, sf_dir)
    return o.plus(c).distinct().rows()


@query("SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey * 2 FROM customer")
def except_all(spark, sf_dir):
    o, c = _keys(spark, sf_dir)
    return o.minus(c).rows()


@query("SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey * 2 FROM customer")
def except_set(spark, sf_dir):
    o, c = _keys(spark, sf_dir)
    return o.subtract(c).rows()


@query("SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey * 2 FROM customer")
def intersect_set(spark, sf_dir):
    o, c = _keys(spark, sf_dir)
    return o.intersect(c).rows()


@query("SELECT k, sum(w)::BIGINT AS w FROM (SELECT o_custkey AS k, -2 AS w FROM orders UNION ALL SELECT c_custkey * 2, 1 FROM customer) GROUP BY k HAVING sum(w) <> 0")
def neg_weights(spark, sf_dir):
    o, c = _keys(spark, sf_dir)
    return o.plus(o).neg().plus(c).norm().df.withColumnRenamed(W, "w")


@query("SELECT r_regionkey, r_name FROM region")
def empty_stream(spark, sf_dir):
    r = table(spark, sf_dir, "region")
    return r.plus(ZSet.empty(spark, r.df.schema)).rows()


# -- aggregates


@query(
    """SELECT l_returnflag, l_linestatus, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS total, count(*)::BIGINT AS n,
       min(round(l_extendedprice * 100)::BIGINT) AS lo, max(round(l_extendedprice * 100)::BIGINT) AS hi FROM lineitem GROUP BY ALL"""
)
def agg_sum_count_min_max(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").map({"l_returnflag": F.col("l_returnflag"), "l_linestatus": F.col("l_linestatus"), "p": cents("l_extendedprice")})
    return li.aggregate({"total": agg_sum("p"), "n": agg_count(), "lo": agg_min("p"), "hi": agg_max("p")}, ["l_returnflag", "l_linestatus"]).rows()


@query("SELECT count(*)::BIGINT AS n, sum(l_quantity::BIGINT)::BIGINT AS q, max(l_orderkey) AS hi FROM lineitem")
def agg_global(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem", "l_quantity", "l_orderkey").map({"q": F.col("l_quantity").cast("long"), "k": F.col("l_orderkey")})
    return li.aggregate({"n": agg_count(), "q": agg_sum("q"), "hi": agg_max("k")}, []).rows()


@query("SELECT o_custkey, floor(sum(CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END * o_orderkey)::DOUBLE / count(*))::BIGINT AS avg FROM orders GROUP BY o_custkey")
def agg_avg_floor(spark, sf_dir):
    o = table(spark, sf_dir, "orders").map({"o_custkey": F.col("o_custkey"), "v": F.when(F.col("o_orderstatus") == "F", -F.col("o_orderkey")).otherwise(F.col("o_orderkey"))})
    out = o.aggregate({"avg": agg_avg("v")}, ["o_custkey"]).rows()
    return out.withColumn("avg", F.col("avg").cast("long"))


AGG_EXPR = """
src := source("lineitem")
src :: stream(struct("l_suppkey": i64, "l_partkey": i64, "l_linenumber": i64))
f :: aggregate_function((struct("l_suppkey": i64, "l_partkey": i64, "l_linenumber": i64)) -> struct("spread": i64, "weighted": i64))
f := function((r) -> struct("spread": std.agg_max_i64(r.l_partkey) - std.agg_min_i64(r.l_partkey), "weighted": std.agg_sum_i64(r.l_partkey * r.l_linenumber)))
by_supplier := aggregate(src, f, by: ["l_suppkey"])
wide :: function((struct("l_suppkey": i64, "spread": i64, "weighted": i64)) -> enum("false","true"))
wide := function((r) -> r.spread > r.l_suppkey)
out := filter(by_supplier, wide)
"""


@query(
    """SELECT l_suppkey, max(l_partkey) - min(l_partkey) AS spread, sum(l_partkey * l_linenumber)::BIGINT AS weighted
       FROM lineitem GROUP BY l_suppkey HAVING max(l_partkey) - min(l_partkey) > l_suppkey"""
)
def agg_expr_having(spark, sf_dir):
    return run(spark, AGG_EXPR, {"lineitem": spark.read.parquet(f"{sf_dir}/lineitem.parquet")}, "out")


@query("SELECT n_regionkey, count(DISTINCT n_name)::BIGINT AS n FROM nation GROUP BY n_regionkey")
def agg_distinct(spark, sf_dir):
    return table(spark, sf_dir, "nation", "n_regionkey", "n_name").distinct().aggregate({"n": agg_count()}, ["n_regionkey"]).rows()


@query(
    """SELECT c_nationkey, string_agg(chr(CASE WHEN x < 10 THEN 48 + x ELSE 55 + x END), '' ORDER BY i) AS x FROM (
         SELECT c_nationkey, i, bit_xor(CASE WHEN ascii(d) < 58 THEN ascii(d) - 48 ELSE ascii(d) - 55 END) AS x FROM (
           SELECT c_nationkey, unnest(range(1, 25)) AS i, substr(upper(hex(lpad(c_custkey::VARCHAR, 12, '0')::BLOB)), i::INT, 1) AS d FROM customer) GROUP BY ALL) GROUP BY c_nationkey"""
)
def agg_xor_bytes(spark, sf_dir):
    c = table(spark, sf_dir, "customer", "c_nationkey", "c_custkey").map({"c_nationkey": F.col("c_nationkey"), "b": F.lpad(F.col("c_custkey").cast("string"), 12, "0").cast("binary")})
    return c.aggregate({"x": agg_xor("b")}, ["c_nationkey"]).rows().withColumn("x", F.hex("x"))


# -- order


@query(
    """SELECT o_orderkey, o_orderpriority, o_custkey, rank() OVER (ORDER BY o_orderpriority, o_custkey DESC)::BIGINT AS rank,
       row_number() OVER (ORDER BY o_orderpriority, o_custkey DESC, o_orderkey)::BIGINT AS row_number FROM orders"""
)
def order_rank_rownum(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority", "o_custkey")
    out = o.order([("o_orderpriority", "asc"), ("o_custkey", "desc")]).rows()
    return out.withColumns({"rank": F.col("rank").cast("long"), "row_number": F.col("row_number").cast("long")})


@query(
    """SELECT o_orderkey, total, row_number FROM (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS total,
       row_number() OVER (ORDER BY round(o_totalprice * 100)::BIGINT DESC, o_orderkey)::BIGINT AS row_number FROM orders) WHERE row_number <= 25"""
)
def order_topk(spark, sf_dir):
    o = table(spark, sf_dir, "orders").map({"o_orderkey": F.col("o_orderkey"), "total": cents("o_totalprice")})
    return o.order([("total", "desc")]).filter(F.col("row_number") <= 25).project(["o_orderkey", "total", "row_number"]).rows().withColumn("row_number", F.col("row_number").cast("long"))


# -- retraction


def _retracted(spark, sf_dir) -> ZSet:
    """All orders, then those of status F taken back."""
    o = table(spark, sf_dir, "orders").map({"o_orderkey": F.col("o_orderkey"), "o_custkey": F.col("o_custkey"), "o_orderstatus": F.col("o_orderstatus"), "total": cents("o_totalprice")})
    return o.plus(o.filter(F.col("o_orderstatus") == "F").neg())


@query("SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice * 100)::BIGINT AS total FROM orders WHERE o_orderstatus <> 'F'")
def retract_net(spark, sf_dir):
    return _retracted(spark, sf_dir).rows()


@query("SELECT o_custkey, max(round(o_totalprice * 100)::BIGINT) AS hi, min(round(o_totalprice * 100)::BIGINT) AS lo, count(*)::BIGINT AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey")
def retract_agg_max(spark, sf_dir):
    return _retracted(spark, sf_dir).aggregate({"hi": agg_max("total"), "lo": agg_min("total"), "n": agg_count()}, ["o_custkey"]).rows()


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'F')")
def retract_antijoin(spark, sf_dir):
    o = _retracted(spark, sf_dir).map({"c_custkey": F.col("o_custkey")})
    return table(spark, sf_dir, "customer", "c_custkey").antijoin(o, ["c_custkey"]).rows()


# -- epochs: a day of events is an epoch


EVENTS = """
src := source("events")
src :: stream(struct("user_id": i64, "event_type": string("UTF-8")))
late := delay(src)
same := integrate(src)
changes := differentiate(src)
n :: aggregate_function((struct("user_id": i64, "event_type": string("UTF-8"))) -> struct("n": integer))
n := function((r) -> struct("n": std.agg_count()))
counts := aggregate(src, n, by: ["event_type"])
users := distinct(project(src, ["user_id"]))
"""
_DAYS = "(date_diff('day', DATE '2024-01-01', ts::DATE))"


def _log(spark, sf_dir) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("user_id", "event_type", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long").alias("__e"), F.lit(1).cast("long").alias("__w"))


def _replayed(spark, sf_dir, name: str) -> DataFrame:
    out = Plan(EVENTS).replay(spark, {"events": _log(spark, sf_dir)}, [name])[name].df
    return out.withColumnsRenamed({replay.E: "e", W: "w"})


@query(f"SELECT {_DAYS} + 1 AS e, user_id, event_type, count(*)::BIGINT AS w FROM events GROUP BY ALL")
def delay_epochs(spark, sf_dir):
    return _replayed(spark, sf_dir, "late")


@query(f"SELECT {_DAYS} AS e, user_id, event_type, count(*)::BIGINT AS w FROM events GROUP BY ALL")
def integrate_running(spark, sf_dir):
    return _replayed(spark, sf_dir, "same")


@query(f"SELECT {_DAYS} AS e, user_id, event_type, count(*)::BIGINT AS w FROM events GROUP BY ALL")
def differentiate_daily(spark, sf_dir):
    return _replayed(spark, sf_dir, "changes")


@query(f"SELECT min({_DAYS}) AS e, user_id, 1::BIGINT AS w FROM events GROUP BY user_id")
def replay_distinct(spark, sf_dir):
    return _replayed(spark, sf_dir, "users")


@query(
    f"""WITH d AS (SELECT {_DAYS} AS e, event_type, count(*) AS c FROM events GROUP BY ALL),
        r AS (SELECT e, event_type, sum(c) OVER (PARTITION BY event_type ORDER BY e) AS n, lead(e) OVER (PARTITION BY event_type ORDER BY e) AS nxt FROM d)
        SELECT e, event_type, n::BIGINT AS n, 1::BIGINT AS w FROM r UNION ALL SELECT nxt, event_type, n::BIGINT, -1::BIGINT FROM r WHERE nxt IS NOT NULL"""
)
def replay_aggregate(spark, sf_dir):
    return _replayed(spark, sf_dir, "counts").withColumn("n", F.col("n").cast("long"))


# -- recursion


CLOSURE = """
ties := source("ties")
ties :: stream(struct("origin": i64, "at": i64))
circuit going(tie: t, line: l):
    line := distinct(plus(t, map(join(l, map(t, as_step), on: ["at"]), moved)))
as_step :: function((struct("origin": i64, "at": i64)) -> struct("at": i64, "to": i64))
as_step := function((t) -> struct("at": t.origin, "to": t.at))
moved :: function((struct("origin": i64, "at": i64, "to": i64)) -> struct("origin": i64, "at": i64))
moved := function((l) -> struct("origin": l.origin, "at": l.to))
lines := fixpoint(going(tie: ties, line: empty()))
out := lines.line
size :: aggregate_function((struct("origin": i64, "at": i64)) -> struct("n": integer))
size := function((l) -> struct("n": std.agg_count()))
counts := aggregate(lines.line, size, by: ["origin"])
tops := filter(lines.line, top)
top :: function((struct("origin": i64, "at": i64)) -> enum("false","true"))
top := function((l) -> l.origin - l.at > l.at)
again := fixpoint(going(tie: tops, line: empty()))
beyond := again.line
"""


def _tree(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey > 1").select(F.col("c_custkey").alias("origin"), F.expr("c_custkey div 2").alias("at"))


@query(
    """WITH RECURSIVE e AS (SELECT c_custkey AS f, c_custkey // 2 AS t FROM customer WHERE c_custkey > 1),
       r(f, t) AS (SELECT f, t FROM e UNION SELECT e.f, r.t FROM e JOIN r ON e.t = r.f) SELECT f AS origin, t AS "at" FROM r"""
)
def fixpoint_tree(spark, sf_dir):
    return run(spark, CLOSURE, {"ties": _tree(spark, sf_dir)}, "out")


@query(
    """WITH RECURSIVE e AS (SELECT n_nationkey::BIGINT AS f, ((7 * n_nationkey + 3) % 25)::BIGINT AS t FROM nation),
       r(f, t) AS (SELECT f, t FROM e UNION SELECT e.f, r.t FROM e JOIN r ON e.t = r.f) SELECT f AS origin, count(*)::BIGINT AS n FROM r GROUP BY f"""
)
def fixpoint_cycle(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("origin"), ((F.col("n_nationkey") * 7 + 3) % 25).cast("long").alias("at"))
    return run(spark, CLOSURE, {"ties": e}, "counts").withColumn("n", F.col("n").cast("long"))


COUNTDOWN = """
src := source("seed")
src :: stream(struct("v": i64, "one": i64))
circuit countdown(base: b, result: r):
    result := distinct(plus(b, map(filter(r, positive), less)))
circuit parity(base: b, even: e, odd: o):
    odd := distinct(map(filter(e, positive), less))
    even := distinct(plus(b, map(filter(o, positive), less)))
positive :: function((struct("v": i64, "one": i64)) -> enum("false","true"))
positive := function((r) -> r.v > r.one - r.one)
less :: function((struct("v": i64, "one": i64)) -> struct("v": i64, "one": i64))
less := function((r) -> struct("v": r.v - r.one, "one": r.one))
fp := fixpoint(countdown(base: src, result: empty()))
down := project(fp.result, ["v"])
both := fixpoint(parity(base: src, even: empty(), odd: empty()))
odds := project(both.odd, ["v"])
"""


def _seed(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/region.parquet").where("r_regionkey >= 3").select((F.col("r_regionkey") * 3).cast("long").alias("v"), F.lit(1).cast("long").alias("one"))


@query("SELECT unnest(range(0, (SELECT max(r_regionkey) * 3 + 1 FROM region)))::BIGINT AS v")
def fixpoint_countdown(spark, sf_dir):
    return run(spark, COUNTDOWN, {"seed": _seed(spark, sf_dir)}, "down")


@query(
    """WITH RECURSIVE r(v, p) AS (SELECT r_regionkey * 3, 0 FROM region WHERE r_regionkey >= 3 UNION SELECT v - 1, 1 - p FROM r WHERE v > 0)
       SELECT v::BIGINT AS v FROM r WHERE p = 1"""
)
def fixpoint_mutual(spark, sf_dir):
    return run(spark, COUNTDOWN, {"seed": _seed(spark, sf_dir)}, "odds")


@query(
    """WITH RECURSIVE e AS (SELECT n_nationkey::BIGINT AS f, ((7 * n_nationkey + 3) % 25)::BIGINT AS t FROM nation),
       a(f, t) AS (SELECT f, t FROM e UNION SELECT e.f, a.t FROM e JOIN a ON e.t = a.f),
       k AS (SELECT * FROM e WHERE f % 5 <> 0),
       b(f, t) AS (SELECT f, t FROM k UNION SELECT k.f, b.t FROM k JOIN b ON k.t = b.f)
       SELECT 0::BIGINT AS e, f AS origin, t AS "at", 1::BIGINT AS w FROM a UNION ALL SELECT 1::BIGINT, f, t, -1::BIGINT FROM (SELECT * FROM a EXCEPT SELECT * FROM b)"""
)
def fixpoint_retract(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("origin"), ((F.col("n_nationkey") * 7 + 3) % 25).cast("long").alias("at"))
    first = e.withColumns({"__e": F.lit(0).cast("long"), "__w": F.lit(1).cast("long")})
    back = e.where("origin % 5 = 0").withColumns({"__e": F.lit(1).cast("long"), "__w": F.lit(-1).cast("long")})
    return Plan(CLOSURE).replay(spark, {"ties": first.union(back)}, ["out"])["out"].df.withColumnsRenamed({replay.E: "e", W: "w"})


# -- programs


SALES = """
customers := source("customer")
customers :: stream(struct("c_custkey": i64, "c_name": string("UTF-8")))
orders := source("orders")
orders :: stream(struct("o_orderkey": i64, "o_custkey": i64))
lines := source("lineitem")
lines :: stream(struct("l_orderkey": i64, "l_quantity": i64, "price": i64))

circuit keyed(orders: o, lines: l):
    renamed := map(l, with_key)
    both := join(o, renamed, on: ["o_orderkey"])

with_key :: function((struct("l_orderkey": i64, "l_quantity": i64, "price": i64)) -> struct("o_orderkey": i64, "l_quantity": i64, "price": i64))
with_key := function((r) -> struct("o_orderkey": r.l_orderkey, "l_quantity": r.l_quantity, "price": r.price))
joined := keyed(orders: orders, lines: lines)

spend :: aggregate_function((struct("o_orderkey": i64, "o_custkey": i64, "l_quantity": i64, "price": i64)) -> struct("total": i64, "lines": integer))
spend := function((r) -> struct("total": std.agg_sum_i64(r.l_quantity * r.price), "lines": std.agg_count()))
per_customer := aggregate(joined.both, spend, by: ["o_custkey"])

rename :: function((struct("o_custkey": i64, "total": i64, "lines": integer)) -> struct("c_custkey": i64, "total": i64, "lines": integer))
rename := function((r) -> struct("c_custkey": r.o_custkey, "total": r.total, "lines": r.lines))
named := join(customers, map(per_customer, rename), on: ["c_custkey"])
ranked := order(named, by: [["total", "desc"], ["c_custkey", "asc"]], rank_column: "rank", row_number_column: "row_number")
"""


def _sales(spark, sf_dir) -> dict[str, DataFrame]:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.col("l_quantity").cast("long").alias("l_quantity"), cents("l_extendedprice").alias("price"))
    return {"customer": spark.read.parquet(f"{sf_dir}/customer.parquet"), "orders": spark.read.parquet(f"{sf_dir}/orders.parquet"), "lineitem": li}


_SALES_SQL = """SELECT c_custkey, c_name, sum(l_quantity::BIGINT * round(l_extendedprice * 100)::BIGINT)::BIGINT AS total, count(*)::BIGINT AS lines
    FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL"""


@query(_SALES_SQL)
def lang_program(spark, sf_dir):
    return run(spark, SALES, _sales(spark, sf_dir), "named").withColumn("lines", F.col("lines").cast("long"))


@query(f"SELECT *, rank() OVER (ORDER BY total DESC, c_custkey)::BIGINT AS rank, row_number() OVER (ORDER BY total DESC, c_custkey)::BIGINT AS row_number FROM ({_SALES_SQL})")
def lang_ranked(spark, sf_dir):
    out = run(spark, SALES, _sales(spark, sf_dir), "ranked")
    return out.withColumns({c: F.col(c).cast("long") for c in ("lines", "rank", "row_number")})


@query("SELECT o_orderkey, o_custkey, l_quantity::BIGINT AS l_quantity, round(l_extendedprice * 100)::BIGINT AS price FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def circuit_macro(spark, sf_dir):
    return run(spark, SALES, _sales(spark, sf_dir), "joined.both")


def revenue_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: scan, join, aggregate."""
    return lang_program(spark, sf_dir)


from . import function_queries  # noqa: E402, F401  registers its queries
