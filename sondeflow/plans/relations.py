"""Joins, curve lookups, neighbours, folds and contract checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sondeflow.functions import scalars as S
from sondeflow.operators import curves as C
from sondeflow.operators import folds, joins, nearby, spatial, validation
from sondeflow.operators.aggregates import content_signature
from sondeflow.plans.base import WELLS_SQL, rounded, table, wells
from sondeflow.plans.registry import query


@query("attach_lookup", "SELECT l_orderkey, l_linenumber, o_custkey, o_orderpriority FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def attach_lookup(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority")
    out = joins.attach(table(spark, sf_dir, "lineitem"), o, ["l_orderkey"], complete=False)
    return out.select("l_orderkey", "l_linenumber", "o_custkey", "o_orderpriority")


@query("star_join", "SELECT r_name, p_brand, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey GROUP BY r_name, p_brand")
def star_join(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    j = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("r_name", "p_brand").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("outer_fallback", "WITH a AS (SELECT doc_id AS k, quality AS v FROM labels), b AS (SELECT doc_id AS k, length(text) % 7 AS v FROM documents WHERE lang <> 'en') SELECT k, CAST(coalesce(a.v, b.v) AS BIGINT) AS v, CASE WHEN a.v IS NULL THEN 'b' WHEN b.v IS NULL THEN 'a' ELSE 'both' END AS origin FROM a FULL JOIN b USING (k)")
def outer_fallback(spark, sf_dir):
    a = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("k"), F.col("quality").cast("long").alias("v"))
    b = table(spark, sf_dir, "documents").filter("lang <> 'en'").select(F.col("doc_id").alias("k"), (F.length("text") % 7).cast("long").alias("v"))
    return joins.either_side(a, b, ["k"], "v")


@query("left_fallback", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_fallback(spark, sf_dir):
    return joins.with_fallback(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"], "quality", F.lit(-1))


@query(
    "all_inner",
    "WITH a AS (SELECT l_partkey AS k, avg(l_quantity) AS v FROM lineitem GROUP BY 1), b AS (SELECT p_partkey AS k, p_retailprice AS v FROM part), c AS (SELECT l_partkey AS k, sum(l_tax) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT k, round(a.v, 6) AS quantity, round(b.v, 6) AS price, round(c.v, 6) AS tax FROM a JOIN b USING (k) JOIN c USING (k)",
)
def all_inner(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("k", F.col("l_partkey"))
    frames = {"quantity": li.groupBy("k").agg(F.avg("l_quantity").alias("v")), "price": table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("v")), "tax": li.filter("l_returnflag = 'R'").groupBy("k").agg(F.sum("l_tax").alias("v"))}
    return rounded(joins.all_inner(frames, ["k"], "v"))


@query("by_position", "WITH a AS (SELECT o_custkey AS k, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders), b AS (SELECT o_custkey AS k, o_orderkey AS by_price, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS place FROM orders) SELECT * FROM a JOIN b USING (k, place)")
def by_position(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("k", F.col("o_custkey"))
    a, b = o.select("k", "o_orderkey", "o_orderdate"), o.select("k", F.col("o_orderkey").alias("by_price"), "o_totalprice")
    return joins.by_position(a, b, ["o_orderdate", "o_orderkey"], ["o_totalprice", "by_price"], "k").select("k", "place", "o_orderkey", "by_price")


@query(
    "by_rounded",
    "WITH r AS (SELECT round_even(p_retailprice, 0) AS a, min(p_partkey) AS p_partkey FROM part GROUP BY 1) SELECT s_suppkey, p_partkey FROM supplier LEFT JOIN r ON round_even(s_acctbal, 0) = a",
)
def by_rounded(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_retailprice").alias("a"), "p_partkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("a"))
    return joins.by_rounded(s, p, ["a"], 0, ["p_partkey"]).select("s_suppkey", "p_partkey")


@query("semi_and_anti", "SELECT doc_id, true AS labelled FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, false FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def semi_and_anti(spark, sf_dir):
    d, lab = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    return joins.present_in(d, lab, ["doc_id"]).withColumn("labelled", F.lit(True)).union(joins.absent_from(d, lab, ["doc_id"]).withColumn("labelled", F.lit(False)))


_GRID = "grid AS (SELECT p_size AS g_at, avg(p_retailprice) / 10 AS g_value FROM part GROUP BY p_size)"


def _grid(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("g_at")).agg((F.avg("p_retailprice") / 10).alias("g_value"))


@query(
    "window_candidates",
    f"WITH {_GRID}, e AS (SELECT event_id, CAST(user_id % 50 AS INT) AS place, value FROM events) SELECT event_id, g_at AS match, round(abs(g_value - value), 6) AS cost FROM e JOIN grid ON g_at BETWEEN place - 5 AND place + 5 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(g_value - value), g_at) = 1",
)
def window_candidates(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 50).cast("int").alias("at"), "value")
    return rounded(joins.window_candidates(e, _grid(spark, sf_dir), "at", 5, "value").select("event_id", "match", "cost"))


@query(
    "nearest_of_kinds",
    "SELECT a, b, kind, round(distance, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS rank FROM (SELECT x.s_suppkey AS a, y.s_suppkey AS b, y.s_nationkey AS kind, abs(x.s_acctbal - y.s_acctbal) AS distance FROM supplier x JOIN supplier y ON x.s_suppkey <> y.s_suppkey QUALIFY row_number() OVER (PARTITION BY x.s_suppkey, y.s_nationkey ORDER BY abs(x.s_acctbal - y.s_acctbal), y.s_suppkey) = 1)) WHERE rank <= 3",
)
def nearest_of_kinds(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    a, b = s.select(F.col("s_suppkey").alias("a"), F.col("s_acctbal").alias("va")), s.select(F.col("s_suppkey").alias("b"), F.col("s_acctbal").alias("vb"), F.col("s_nationkey").alias("kind"))
    return rounded(joins.nearest_of_kinds(a, b, ("va", "vb"), "a", "b", "kind", 3).select("a", "b", "kind", "distance", "rank"))


def _curve_sql(edge: str) -> str:
    inside = "y0 + (y1 - y0) * (v - x0) / (x1 - x0)"
    outside = {
        "clamp": "CASE WHEN v <= lo THEN ylo WHEN v >= hi THEN yhi",
        "null": "CASE WHEN v < lo OR v > hi THEN NULL WHEN v = hi THEN yhi",
        "extrapolate": "CASE WHEN v < lo THEN ylo + (y2 - ylo) * (v - lo) / (x2 - lo) WHEN v >= hi THEN yl + (yhi - yl) * (v - xl) / (hi - xl)",
    }[edge]
    return f"""WITH k AS (SELECT o_custkey AS c, epoch(o_orderdate) / 86400 AS x, avg(o_totalprice) AS y FROM orders GROUP BY 1, 2),
    s AS (SELECT c, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM k WINDOW w AS (PARTITION BY c ORDER BY x)),
    n AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY x) AS i, count(*) OVER (PARTITION BY c) AS n, x, y FROM k),
    e AS (SELECT c, max(n) AS n, min(x) AS lo, max(x) AS hi, arg_min(y, x) AS ylo, arg_max(y, x) AS yhi, max(CASE WHEN i = 2 THEN x END) AS x2, max(CASE WHEN i = 2 THEN y END) AS y2, max(CASE WHEN i = n - 1 THEN x END) AS xl, max(CASE WHEN i = n - 1 THEN y END) AS yl FROM n GROUP BY c),
    r AS (SELECT user_id AS c, event_id, epoch(ts) / 86400 AS v FROM events),
    j AS (SELECT r.*, e.*, s.x0, s.y0, s.x1, s.y1 FROM r JOIN e ON r.c = e.c ASOF LEFT JOIN s ON r.c = s.c AND r.v >= s.x0)
    SELECT event_id, round(CASE WHEN n = 1 THEN {'CASE WHEN v = lo THEN ylo END' if edge == 'null' else 'ylo'} ELSE {outside} ELSE {inside} END END, 4) AS y FROM j"""


def _order_curves(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6 / 86400).alias("x"), F.col("o_totalprice").alias("y"))
    return C.curves(o, "c", "x", "y")


def _curve_query(edge: str):
    @query(f"curve_{edge}", _curve_sql(edge))
    def curve(spark, sf_dir):
        e = table(spark, sf_dir, "events").select(F.col("user_id").alias("c"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 86400).alias("v"))
        j = e.join(_order_curves(spark, sf_dir), "c")
        return rounded(j.select("event_id", C.lookup(F.col("knots"), F.col("v"), edge).alias("y")), 4)


def _merged_query(edge: str):
    @query(f"curve_merged_{edge}", _curve_sql(edge))
    def merged(spark, sf_dir):
        """The same values by one sort of rows and knots together: no curve is held in a row."""
        e = table(spark, sf_dir, "events").select(F.col("user_id").alias("c"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 86400).alias("v"))
        o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6 / 86400).alias("x"), F.col("o_totalprice").alias("y"))
        out = C.along(e.join(o.select("c").distinct(), "c", "left_semi"), o, "c", "v", "x", "y", "y", edge)
        return rounded(out.select("event_id", "y"), 4)


for _edge in ("clamp", "extrapolate", "null"):
    _curve_query(_edge)
    _merged_query(_edge)


@query(
    "nearest_knot",
    f"WITH {_GRID} SELECT event_id, (SELECT g_at FROM grid ORDER BY abs(g_at * 10 - value), g_at LIMIT 1) AS knot FROM events",
)
def nearest_knot(spark, sf_dir):
    g = _grid(spark, sf_dir).select(F.lit(0).alias("k"), (F.col("g_at") * 10).alias("x"), "g_value")
    e = table(spark, sf_dir, "events").select("event_id", "value", F.lit(0).alias("k"))
    j = e.join(F.broadcast(C.curves(g, "k", "x", "g_value")), "k")
    return j.select("event_id", (C.nearest_knot(F.col("knots"), F.col("value"))["x"] / 10).cast("int").alias("knot"))


@query(
    "as_of_knot",
    "SELECT event_id, o_totalprice AS y0 FROM events e ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1, 2) o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate",
)
def as_of_knot(spark, sf_dir):
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), "event_id", at("ts").alias("v"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), at("o_orderdate").alias("x"), "o_totalprice").groupBy("k", "x").agg(F.max("o_totalprice").alias("y"))
    return C.as_of(e, o, "k", "v", "x", "y").select("event_id", "y0")


@query("grid_lookup", f"WITH {_GRID}, v AS (SELECT event_id, least(greatest(value / 10 - 1, 0), 49) AS p FROM events), i AS (SELECT *, least(floor(p), 48)::INT AS i FROM v) SELECT event_id, round(a.g_value + (b.g_value - a.g_value) * (p - i), 6) AS y FROM i JOIN grid a ON a.g_at = i + 1 JOIN grid b ON b.g_at = i + 2")
def grid_lookup(spark, sf_dir):
    g = _grid(spark, sf_dir).agg(F.transform(F.array_sort(F.collect_list(F.struct("g_at", "g_value"))), lambda s: s["g_value"]).alias("values"))
    e = table(spark, sf_dir, "events").join(F.broadcast(g))
    return rounded(e.select("event_id", C.on_grid(F.col("values"), F.lit(1.0), 1.0, F.col("value") / 10).alias("y")))


@query(
    "resampled",
    f"WITH {_GRID}, t AS (SELECT i, 1 + i * 2.5::DOUBLE AS x FROM range(20) t(i)) SELECT i, round(x, 6) AS x, round(a.g_value + (b.g_value - a.g_value) * (x - a.g_at), 6) AS y FROM t JOIN grid a ON a.g_at = least(floor(x), 49) JOIN grid b ON b.g_at = a.g_at + 1",
)
def resampled(spark, sf_dir):
    g = _grid(spark, sf_dir).select(F.lit(0).alias("k"), "g_at", "g_value")
    return rounded(C.resampled(C.curves(g, "k", "g_at", "g_value"), "k", 2.5).select("i", "x", "y"))


@query(
    "curve_probes",
    f"WITH {_GRID}, r AS (SELECT event_id, value, greatest(least(user_id % 50 + o, 50), 1)::DOUBLE AS v, o FROM events, (VALUES (-2.0::DOUBLE), (-0.5), (0), (1.5)) t(o)) SELECT event_id, o, round(value - (a.g_value + (b.g_value - a.g_value) * (v - a.g_at)), 6) AS residual FROM r JOIN grid a ON a.g_at = least(floor(v), 49) JOIN grid b ON b.g_at = a.g_at + 1",
)
def curve_probes(spark, sf_dir):
    offsets = [-2.0, -0.5, 0.0, 1.5]
    g = _grid(spark, sf_dir).select(F.lit(0).alias("k"), "g_at", "g_value")
    e = table(spark, sf_dir, "events").withColumn("k", F.lit(0)).join(F.broadcast(C.curves(g, "k", "g_at", "g_value")), "k")
    r = e.withColumn("r", C.probes(F.col("knots"), (F.col("user_id") % 50).cast("double"), F.col("value"), offsets))
    out = r.select("event_id", F.explode(F.arrays_zip(F.array(*map(F.lit, offsets)).alias("o"), F.col("r").alias("r"))).alias("p"))
    return rounded(out.select("event_id", F.col("p.o").alias("o"), F.col("p.r").alias("residual")))


_POINTS = "pts AS (SELECT c_custkey AS id, c_nationkey AS who, c_acctbal AS px, (c_custkey % 997)::DOUBLE * 10 AS py FROM customer)"


def _points(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("who"), F.col("c_acctbal").alias("px"), ((F.col("c_custkey") % 997) * 10.0).alias("py"))


_NEAR = f"WITH {_POINTS}, near AS (SELECT q.id AS qid, p.id AS pid, q.px AS qx, q.py AS qy, p.px, p.py, p.px / 100 + p.py AS v, sqrt((q.px - p.px) * (q.px - p.px) + (q.py - p.py) * (q.py - p.py)) AS distance FROM pts q JOIN pts p ON q.who <> p.who QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY distance, p.id) <= 8)"


def _near(spark, sf_dir):
    p = _points(spark, sf_dir)
    q = p.select(F.col("id").alias("qid"), F.col("who").alias("qwho"), F.col("px").alias("qx"), F.col("py").alias("qy"))
    return nearby.nearest(q, p.select(F.col("id").alias("pid"), F.col("who").alias("pwho"), "px", "py", (F.col("px") / 100 + F.col("py")).alias("v")), 8)


@query("spatial_neighbours", f"{_NEAR} SELECT qid, pid, round(distance, 6) AS distance FROM near")
def spatial_neighbours(spark, sf_dir):
    return rounded(_near(spark, sf_dir).select("qid", "pid", "distance"))


@query("inverse_distance", f"{_NEAR} SELECT qid, round(sum(v / (distance + 1e-6)) / sum(1 / (distance + 1e-6)), 4) AS idw, round(min(distance), 6) AS near FROM near GROUP BY qid")
def inverse_distance(spark, sf_dir):
    out = spatial.inverse_distance(_near(spark, sf_dir), "v")
    return out.select("qid", F.round("idw", 4).alias("idw"), F.round("near", 6).alias("near"))


@query("local_planes", f"{_NEAR} SELECT DISTINCT qid, round(qx / 100 + qy, 5) AS plane FROM near")
def local_planes(spark, sf_dir):
    """The points' values lie on a plane, so the SQL may state the answer."""
    out = spatial.local_planes(_near(spark, sf_dir), "v", ridge=0.0)
    return out.select("qid", F.round("plane", 5).alias("plane"))


@query("standardised", "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS c_acctbal FROM customer")
def standardised(spark, sf_dir):
    return rounded(spatial.standardised(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]))


@query("clusters")
def clusters(spark, sf_dir):
    p = spatial.standardised(_points(spark, sf_dir), ["px", "py"])
    return spatial.clusters(p, ["px", "py"], 6).select("id", "cluster")


_BALANCED = """WITH RECURSIVE o AS (SELECT user_id AS k, count(*)::DOUBLE AS load, row_number() OVER (ORDER BY count(*) DESC, user_id) AS i FROM events GROUP BY 1),
    r(i, k, load, fold, loads) AS (SELECT 0::BIGINT, NULL::BIGINT, 0::DOUBLE, -1, [0, 0, 0, 0, 0]::DOUBLE[] UNION ALL
    SELECT o.i, o.k, o.load, list_position(r.loads, list_min(r.loads)) - 1, list_transform(r.loads, lambda v, j: CASE WHEN j = list_position(r.loads, list_min(r.loads)) THEN v + o.load ELSE v END) FROM r JOIN o ON o.i = r.i + 1)
    SELECT k, load, CAST(fold AS INT) AS fold FROM r WHERE i > 0"""


@query("balanced_folds", _BALANCED)
def balanced_folds(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("k")).agg(F.count("*").cast("double").alias("load"))
    return folds.balanced(e, "k", "load", 5)


@query("fold_balance", f"SELECT fold, count(*) AS entities, sum(load) AS load FROM ({_BALANCED}) GROUP BY fold")
def fold_balance(spark, sf_dir):
    return folds.balance(balanced_folds(spark, sf_dir), "load")


@query(
    "signature_folds",
    "WITH s AS (SELECT conv_id, md5(string_agg(concat_ws(',', coalesce(role, '')), ';' ORDER BY turn)) AS signature, conv_id % 5 AS fold FROM conversations GROUP BY conv_id) SELECT conv_id, CAST(arg_min(fold, conv_id) OVER (PARTITION BY signature) AS BIGINT) AS fold FROM s",
)
def signature_folds(spark, sf_dir):
    s = content_signature(table(spark, sf_dir, "conversations"), "conv_id", "turn", ["role"]).withColumn("fold", F.col("conv_id") % 5)
    return folds.merged_by_signature(s, "conv_id", "signature").select("conv_id", "fold")


@query("hashed_folds", "SELECT c_custkey, c_nationkey, CAST((row_number() OVER (PARTITION BY c_nationkey ORDER BY substr(md5('42:' || c_custkey), 1, 15), c_custkey) - 1) % 5 AS INT) AS fold FROM customer")
def hashed_folds(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return folds.hashed(c, "c_custkey", 5, strata=["c_nationkey"])


@query("row_ids", f"WITH {WELLS_SQL} SELECT concat(well, '_', row_idx) AS id, CAST(well AS VARCHAR) AS key, row_idx AS index FROM wells")
def row_ids(spark, sf_dir):
    out = wells(spark, sf_dir).select(S.row_id(F.col("well"), F.col("row_idx")).alias("id"))
    return out.select("id", S.id_key(F.col("id")).alias("key"), S.id_index(F.col("id")).alias("index"))


@query("broken_tails", f"WITH {WELLS_SQL}, g AS (SELECT well, row_idx, gr, min(CASE WHEN gr IS NULL THEN row_idx END) OVER (PARTITION BY well) AS f FROM wells) SELECT well, count(*) FILTER (row_idx >= f AND gr IS NOT NULL) AS late FROM g GROUP BY well HAVING count(*) FILTER (row_idx >= f AND gr IS NOT NULL) > 0")
def broken_tails(spark, sf_dir):
    return validation.broken_tails(wells(spark, sf_dir), "gr", "well", "row_idx")


@query("order_mismatches", "WITH a AS (SELECT o_custkey AS g, o_orderkey AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders), b AS (SELECT o_custkey AS g, o_orderkey AS b, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders WHERE o_orderkey % 10 <> 0) SELECT g, place, a, b FROM a FULL JOIN b USING (g, place) WHERE a IS DISTINCT FROM b")
def order_mismatches(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("g", F.col("o_custkey"))
    return validation.order_mismatches(o, o.filter("o_orderkey % 10 <> 0"), ["o_orderkey"], ["o_orderdate", "o_orderkey"], "o_orderkey", "g")


@query("largest_gap", f"WITH {WELLS_SQL} SELECT well, round(max(abs(tvt_input - tvt)), 6) AS gap, count(*) FILTER (tvt IS NOT NULL AND tvt_input IS NULL) AS unmatched FROM wells GROUP BY well")
def largest_gap(spark, sf_dir):
    return rounded(validation.largest_gap(wells(spark, sf_dir), "tvt", "tvt_input", ["well"]))


@query("fold_faults", "SELECT 0::BIGINT AS repeated, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS without_fold, 0::BIGINT AS unknown, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey % 7 >= 5) AS out_of_range")
def fold_faults(spark, sf_dir):
    f = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct().withColumn("fold", (F.col("k") % 7).cast("int"))
    return validation.fold_faults(f, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), "k", 5)


@query("same_sets", "SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS only_a, (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) AS only_b, (SELECT count(*) FROM (SELECT doc_id FROM labels INTERSECT SELECT doc_id FROM documents)) AS both")
def same_sets(spark, sf_dir):
    return validation.same_sets(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("not_finite", f"WITH {WELLS_SQL} SELECT count(*) FILTER (gr IS NULL) AS gr, count(*) FILTER (tvt_input IS NULL) AS tvt_input, 0::BIGINT AS md FROM wells")
def not_finite(spark, sf_dir):
    return validation.not_finite(wells(spark, sf_dir), ["gr", "tvt_input", "md"])
