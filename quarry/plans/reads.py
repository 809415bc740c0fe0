"""Read plans of order-entry and brokerage shape, each over whole parameter tables at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import scalars
from quarry.operators import arrays, scans
from quarry.session import broadcast_if_small, load


def _t(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [load(spark, d, n) for n in names]


def min_quantity_supplier(spark, d):
    """Per part the supplier of one region with the smallest lot, parts without 'b' in their name."""
    r, n, s, l, p = _t(spark, d, "region", "nation", "supplier", "lineitem", "part")
    near = r.where("r_name = 'EUROPE'").join(n, F.col("r_regionkey") == F.col("n_regionkey")).join(s, F.col("n_nationkey") == F.col("s_nationkey"))
    lots = l.join(broadcast_if_small(near.select("s_suppkey", "n_name")), F.col("l_suppkey") == F.col("s_suppkey")).join(p.where(~F.col("p_name").contains("b")), F.col("l_partkey") == F.col("p_partkey"))
    best = lots.groupBy("p_partkey").agg(F.min(F.struct("l_quantity", "s_suppkey", "n_name")).alias("m"))
    return best.select("p_partkey", F.col("m.s_suppkey").alias("s_suppkey"), F.col("m.n_name").alias("n_name"), F.col("m.l_quantity").alias("quantity"))


def supplier_by_computed_key(spark, d):
    """Line items joined to suppliers by a computed key, counted."""
    l, s = _t(spark, d, "lineitem", "supplier")
    n = s.count()
    keyed = l.select((F.pmod(F.col("l_partkey") * F.col("l_linenumber"), F.lit(n)) + 1).alias("k"), "l_quantity")
    return keyed.groupBy("k").agg(F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity")).join(s, F.col("k") == F.col("s_suppkey")).select("s_suppkey", "s_name", "lines", F.round("quantity", 2).alias("quantity"))


def balance_check(spark, d):
    """Customers with their open amount: line amounts of orders that are not finished, and a flag."""
    c, o, l = _t(spark, d, "customer", "orders", "lineitem")
    amount = F.round(F.col("l_extendedprice") * 100).cast("long")
    due = o.where("o_orderstatus <> 'F'").join(l, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.sum(amount).alias("cents"))
    j = c.join(due, F.col("c_custkey") == F.col("o_custkey"))
    return j.select("c_custkey", (F.col("cents") / 100).alias("open_amount"), F.when(F.col("c_acctbal") * 100 + F.col("cents") > 50_000_000, "BC").otherwise("GC").alias("flag"))


def recent_distinct_parts(spark, d):
    """Per customer the number of different low-quantity parts in the last 20 orders."""
    o, l = _t(spark, d, "orders", "lineitem")
    last = scans.first_per_group(o.select("o_custkey", "o_orderkey"), ["o_custkey"], [F.desc("o_orderkey")], 20)
    low = last.join(l.where("l_quantity < 15"), F.col("o_orderkey") == F.col("l_orderkey"))
    return low.groupBy("o_custkey").agg(F.countDistinct("l_partkey").alias("parts"))


def order_window(spark, d):
    """Range join: lines of the orders whose number lies in the 20 below each customer's latest."""
    o, l = _t(spark, d, "orders", "lineitem")
    nxt = o.groupBy("o_custkey").agg((F.max("o_orderkey") + 1).alias("next"))
    near = o.join(nxt, "o_custkey").where((F.col("o_orderkey") >= F.col("next") - 20) & (F.col("o_orderkey") < F.col("next")))
    return near.join(l, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("lines"))


def order_status(spark, d):
    """The latest order of every customer with its lines."""
    o, l = _t(spark, d, "orders", "lineitem")
    top = o.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m")).select("o_custkey", F.col("m.o_orderkey").alias("o_orderkey"))
    return top.join(l, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "o_orderkey", "l_linenumber", "l_partkey", "l_quantity")


def oldest_open_order(spark, d):
    """Per customer the oldest open order and its total in cents."""
    o, l = _t(spark, d, "orders", "lineitem")
    first = o.where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    return first.join(l, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey", "o_orderkey").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("total_cents"))


def median_customer(spark, d):
    return scans.median_row(load(spark, d, "customer").select("c_mktsegment", "c_name", "c_custkey"), ["c_mktsegment"], [F.col("c_name"), F.col("c_custkey")])


def supplier_volume(spark, d):
    """Volume by supplier of a list of nations, largest first."""
    r, n, s, l, p = _t(spark, d, "region", "nation", "supplier", "lineitem", "part")
    who = r.join(n, F.col("r_regionkey") == F.col("n_regionkey")).where(F.col("r_name").isin("ASIA", "AMERICA")).join(s, F.col("n_nationkey") == F.col("s_nationkey"))
    v = l.join(broadcast_if_small(who.select("s_suppkey", "s_name")), F.col("l_suppkey") == F.col("s_suppkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    return v.groupBy("s_name").agg(F.sum((F.col("l_quantity") * F.round(F.col("p_retailprice") * 100)).cast("long")).alias("volume_cents")).orderBy(F.desc("volume_cents"), "s_name")


def customer_position(spark, d):
    """Every customer with cash and holdings value; 0 without holdings."""
    c, o, l, p = _t(spark, d, "customer", "orders", "lineitem", "part")
    held = o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    v = held.groupBy("o_custkey").agg(F.sum((F.col("l_quantity") * F.round(F.col("p_retailprice") * 100)).cast("long")).alias("v"))
    return c.join(v, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.round("c_acctbal", 2).alias("cash"), F.coalesce("v", F.lit(0)).alias("asset_cents"))


def market_change(spark, d):
    """Percent change between list value and charged value per brand; 0 if there was no old value."""
    l, p = _t(spark, d, "lineitem", "part")
    j = l.join(p, F.col("l_partkey") == F.col("p_partkey"))
    s = j.groupBy("p_brand").agg(F.sum((F.col("l_quantity") * F.round(F.col("p_retailprice") * 100)).cast("long")).alias("new"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("old"))
    return s.select("p_brand", F.round(scalars.percent_change(F.col("old"), F.col("new")), 6).alias("change"))


def part_detail(spark, d):
    """Suppliers of every part with nation and region, and the customers' nation: one table under two names."""
    l, s, n, r, o, c = _t(spark, d, "lineitem", "supplier", "nation", "region", "orders", "customer")
    sn, cn = n.alias("sn"), n.alias("cn")
    j = l.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(broadcast_if_small(sn), F.col("s_nationkey") == F.col("sn.n_nationkey")).join(broadcast_if_small(r), F.col("sn.n_regionkey") == F.col("r_regionkey"))
    j = j.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(broadcast_if_small(cn), F.col("c_nationkey") == F.col("cn.n_nationkey"))
    return j.groupBy(F.col("r_name"), F.col("sn.n_name").alias("supplier_nation"), F.col("cn.n_name").alias("customer_nation")).agg(F.count(F.lit(1)).alias("lines"))


def first_lines(spark, d):
    """Up to three lines per order; the ship date only of returned ones (conditional left join)."""
    o, l = _t(spark, d, "orders", "lineitem")
    top = scans.first_per_group(l.select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey")], 3)
    ship = l.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_shipdate").alias("returned"))
    j = top.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(ship, (F.col("k") == F.col("o_orderkey")) & (F.col("o_orderstatus") == "F"), "left")
    return j.select("o_orderkey", "l_linenumber", "l_partkey", F.date_format("returned", "yyyy-MM-dd").alias("returned"))


def order_history(spark, d):
    """Per customer the first 50 orders in time."""
    o = load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return scans.first_per_group(o, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], 50).select("o_custkey", "o_orderkey")


def next_order_lines(spark, d):
    """From the first order on or after a date per customer: its lines (top one, then an equi-join)."""
    o, l = _t(spark, d, "orders", "lineitem")
    first = scans.first_per_group(o.where("o_orderdate >= timestamp'1995-01-01'").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])
    return first.join(l, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey", "o_orderkey").agg(F.count(F.lit(1)).alias("lines"))


def tier_lookup(spark, d):
    """First tier whose interval holds a line's quantity."""
    l = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    tiers = spark.createDataFrame([("A", 0, 15, 1.0), ("A", 15, 35, 0.9), ("A", 30, 60, 0.8), ("N", 0, 25, 1.1), ("N", 25, 60, 0.7), ("R", 0, 60, 0.5)], "l_returnflag string, from_q int, to_q int, rate double")
    hit = F.min(F.struct("from_q", "rate"))
    j = l.join(broadcast_if_small(tiers), "l_returnflag").where("from_q < l_quantity and l_quantity <= to_q")
    return j.groupBy("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity").agg(hit.alias("m"), F.count(F.lit(1)).alias("tiers")).groupBy(F.col("m.rate").alias("rate")).agg(F.count(F.lit(1)).alias("lines"))


def _lots(spark, d, lifo):
    l = load(spark, d, "lineitem").groupBy("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber").agg(F.sum(F.col("l_quantity").cast("long")).alias("qty"))
    need = load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") * 5).cast("long").alias("need"))
    taken = scans.consume_lots(l, need, ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber"], "qty", "need", lifo)
    return taken.where("taken > 0").select("l_partkey", "l_orderkey", "l_linenumber", "taken")


def lots_fifo(spark, d):
    return _lots(spark, d, False)


def lots_lifo(spark, d):
    return _lots(spark, d, True)


def feed_triggers(spark, d):
    """Pending requests that a quote sets off: three cases, each with its own comparison."""
    e = load(spark, d, "events").where("value is not null").select("event_id", "event_type", "value")
    quotes = spark.createDataFrame([("view", 20.0), ("click", 40.0), ("purchase", 60.0), ("signup", 30.0), ("error", 10.0)], "event_type string, quote double")
    j = e.join(broadcast_if_small(quotes), "event_type")
    kind = F.element_at(F.array(F.lit("TSL"), F.lit("TLS"), F.lit("TLB")), (F.col("event_id") % 3 + 1).cast("int"))
    return j.withColumn("kind", kind).where(scalars.triggered(F.col("kind"), F.col("value"), F.col("quote"))).select("event_id", "kind")


def range_assets(spark, d):
    """Total value over a tenth of the customers (key range, end exclusive)."""
    c, o, l = _t(spark, d, "customer", "orders", "lineitem")
    hi = c.agg(F.max("c_custkey")).first()[0] // 10
    part = c.where((F.col("c_custkey") >= 1) & (F.col("c_custkey") < hi))
    j = part.join(o, F.col("c_custkey") == F.col("o_custkey")).join(l, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy("c_custkey").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("asset_cents"))


def rate_sum(spark, d):
    """Nested equi-joins summed per key, applied only where a gain remains."""
    c, n, o = _t(spark, d, "customer", "nation", "orders")
    rates = n.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("r"))
    gain = o.groupBy("o_custkey").agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) - 30_000_000).alias("gain"))
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(rates, "n_regionkey").join(gain, F.col("c_custkey") == F.col("o_custkey"))
    return j.select("c_custkey", F.when(F.col("gain") > 0, F.col("gain") * F.col("r")).otherwise(0).alias("amount"))


def permission_probe(spark, d):
    """Customers that have an urgent order (existence) and those that have none (absence), counted."""
    c, o = _t(spark, d, "customer", "orders")
    urgent = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    has = c.join(urgent, "c_custkey", "left_semi").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")).withColumn("urgent", F.lit(True))
    none = c.join(urgent, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")).withColumn("urgent", F.lit(False))
    return has.unionByName(none)


def stale_index_rows(spark, d):
    """Index rows that agree with the base table in key and time; outdated ones drop out."""
    o = load(spark, d, "orders")
    index = o.select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderdate") - F.expr("interval 1 day")).otherwise(F.col("o_orderdate")).alias("t"))
    return index.join(o, (F.col("k") == F.col("o_orderkey")) & (F.col("t") == F.col("o_orderdate"))).select("o_orderkey", "o_custkey")


def weighted_draws(spark, d):
    """Weighted sampling: a hundred fixed draws against the running weights of the parts."""
    from quarry.ml.select import weighted_draw

    p = load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("w"))
    total = p.agg(F.sum("w")).first()[0]
    draws = spark.range(100).select(F.col("id").alias("draw"), ((F.col("id") * 7919 + 17) % total).alias("at"))
    return weighted_draw(p, draws, "id", "w").select("draw", F.col("id").alias("p_partkey"))


def running_share(spark, d):
    """Ordered analytics: running count and sum of the orders of a customer."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    o = load(spark, d, "orders")
    return o.select("o_custkey", "o_orderkey", F.count(F.lit(1)).over(w).alias("nth"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).over(w).alias("so_far_cents"))


def toggle_names(spark, d):
    """String toggles and compositions on part names."""
    p = load(spark, d, "part")
    phrase = F.concat(F.col("p_type"), F.lit(" "), F.col("p_size").cast("string"), F.lit(" shares of "), F.col("p_name"))
    return p.select("p_partkey", scalars.toggle(F.col("p_brand"), "Brand#1", "B1#").alias("brand"), scalars.toggle(phrase, " shares of ", " Shares of ").alias("phrase"), scalars.padded_key(F.col("p_partkey"), 10).alias("key"))


def bit_functions(spark, d):
    """Bit reversal and byte swap of keys."""
    p = load(spark, d, "part")
    return p.select("p_partkey", scalars.reverse_bits(F.col("p_partkey")).alias("reversed"), scalars.reverse_bits(scalars.reverse_bits(F.col("p_partkey"))).alias("back"))


def snapshot_asof(spark, d):
    """The newest event of every user as of the middle of the stream; errors count as deletions."""
    e = load(spark, d, "events").withColumn("t", scalars.ticks(F.col("ts")))
    mid = e.agg(((F.min("t") + F.max("t")) / 2).cast("long")).first()[0]
    v = e.select("user_id", "t", "event_id", (F.col("event_type") == "error").alias("gone"))
    return scans.as_of(v, ["user_id"], "t", mid, "gone").select("user_id", "event_id")


def key_range_scan(spark, d):
    o = load(spark, d, "orders").select("o_custkey", "o_orderkey")
    a = scans.range_scan(o, ["o_custkey", "o_orderkey"], [10, 0], [40, 500]).withColumn("way", F.lit("up"))
    b = scans.reverse_scan(o, ["o_custkey", "o_orderkey"], [40, 500], [10, 0]).withColumn("way", F.lit("down"))
    return a.unionByName(b)


def ycsb_read(spark, d):
    """A thousand hashed key draws read in one join."""
    p = load(spark, d, "part").select(F.col("p_partkey").alias("y_key"), F.col("p_name").alias("y_value"))
    n = p.count()
    req = spark.range(1000).select(F.col("id").alias("op"), ((F.col("id") * 2654435761) % n + 1).alias("y_key"))
    return scans.point_lookup(p, req, ["y_key"]).select("op", "y_key", "y_value")


def ycsb_rmw(spark, d):
    """Read-modify-write of the drawn keys: every write appends to the value read."""
    p = load(spark, d, "part").select(F.col("p_partkey").alias("y_key"), F.col("p_name").alias("y_value"))
    n = p.count()
    w = spark.range(1000).select(((F.col("id") * 2654435761) % n + 1).alias("y_key")).groupBy("y_key").agg(F.count(F.lit(1)).alias("k"))
    changed = p.join(w, "y_key").select("y_key", F.concat("y_value", F.lit("+"), F.col("k").cast("string")).alias("y_value"))
    return scans.upsert(p, changed, ["y_key"])


def unique_sizes(spark, d):
    """Distinct values of an array of part sizes."""
    return arrays.unique(load(spark, d, "part").select(F.col("p_partkey").alias("idx"), F.col("p_size").alias("value")))


def combined_cells(spark, d):
    """Two arrays over nations, customers and suppliers per nation, added up."""
    c, s = _t(spark, d, "customer", "supplier")
    count = lambda t, k: t.groupBy(F.col(k).alias("idx")).agg(F.count(F.lit(1)).alias("value"))
    return arrays.combine(count(c, "c_nationkey"), count(s, "s_nationkey"))


def consecutive_parts(spark, d):
    """Every hundredth part asks for itself and the nine keys behind it."""
    p = load(spark, d, "part").select("p_partkey", "p_size")
    asked = p.where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("start"))
    return scans.consecutive_reads(p, asked, "p_partkey", "start", 10).groupBy("start").agg(F.count(F.lit(1)).alias("found"), F.sum("p_size").alias("total"))


def search_statistics(spark, d):
    """Times of the searches per scale of their graph, the first of each left out, and vertices a second."""
    r = load(spark, d, "bfs_run").withColumns({"size": F.pow(F.lit(2.0), F.col("nv_scale")), "fine": F.col("start_vertex").isNotNull()})
    s = scans.run_statistics(r, ["nv_scale"], "elapsed_s", "size", "fine", "run_id")
    return s.select("nv_scale", "runs", "done", "failed", *[F.round(c, 6).alias(c) for c in ("mean_s", "min_s", "max_s")], F.round("rate", 3).alias("rate"))


def restocked(spark, d):
    """Line quantities per part and supplier as stock: rows below 15 are raised by 50, and only they."""
    l = load(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min("l_quantity").cast("int").alias("quantity"))
    low = l.where("quantity < 15").select("l_partkey", "l_suppkey", (F.col("quantity") + 50).alias("quantity"))
    return scans.upsert(l, low, ["l_partkey", "l_suppkey"])


QUERIES = {
    f.__name__: f
    for f in (
        min_quantity_supplier, supplier_by_computed_key, balance_check, recent_distinct_parts, order_window, order_status, oldest_open_order, median_customer, supplier_volume, customer_position, market_change,
        part_detail, first_lines, order_history, next_order_lines, tier_lookup, lots_fifo, lots_lifo, feed_triggers, range_assets, rate_sum, permission_probe, stale_index_rows, weighted_draws, running_share,
        toggle_names, bit_functions, snapshot_asof, key_range_scan, ycsb_read, ycsb_rmw, unique_sizes, combined_cells, consecutive_parts, search_statistics, restocked,
    )
}


def _lots_sql(way: str) -> str:
    return f"""WITH l AS (SELECT l_partkey, l_shipdate, l_orderkey, l_linenumber, sum(l_quantity::BIGINT) AS qty FROM lineitem GROUP BY ALL),
w AS (SELECT l.*, p_size * 5 AS need, coalesce(sum(qty) OVER (PARTITION BY l_partkey ORDER BY l_shipdate {way}, l_orderkey {way}, l_linenumber {way} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l JOIN part ON p_partkey = l_partkey)
SELECT l_partkey, l_orderkey, l_linenumber, least(qty, greatest(need - before, 0))::BIGINT AS taken FROM w WHERE least(qty, greatest(need - before, 0)) > 0"""


_BITS = "list_sum(list_transform(range(64), lambda i: (((p_partkey >> i) & 1)::HUGEINT << (63 - i))))"

SQL = {
    "min_quantity_supplier": """WITH j AS (SELECT p_partkey, s_suppkey, n_name, l_quantity, row_number() OVER (PARTITION BY p_partkey ORDER BY l_quantity, s_suppkey, n_name) AS rn
  FROM region JOIN nation ON r_regionkey = n_regionkey JOIN supplier ON n_nationkey = s_nationkey JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey
  WHERE r_name = 'EUROPE' AND p_name NOT LIKE '%b%') SELECT p_partkey, s_suppkey, n_name, l_quantity AS quantity FROM j WHERE rn = 1""",
    "supplier_by_computed_key": """WITH k AS (SELECT (l_partkey * l_linenumber) % (SELECT count(*) FROM supplier) + 1 AS k, l_quantity FROM lineitem)
SELECT s_suppkey, s_name, count(*) AS lines, round(sum(l_quantity), 2) AS quantity FROM k JOIN supplier ON s_suppkey = k GROUP BY ALL""",
    "balance_check": """SELECT c_custkey, s / 100.0::DOUBLE AS open_amount, CASE WHEN c_acctbal * 100 + s > 50000000 THEN 'BC' ELSE 'GC' END AS flag
FROM customer JOIN (SELECT o_custkey, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F' GROUP BY ALL) ON o_custkey = c_custkey""",
    "recent_distinct_parts": """SELECT o_custkey, count(DISTINCT l_partkey) AS parts FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) JOIN lineitem ON o_orderkey = l_orderkey
WHERE rn <= 20 AND l_quantity < 15 GROUP BY o_custkey""",
    "order_window": """WITH n AS (SELECT o_custkey, max(o_orderkey) + 1 AS nx FROM orders GROUP BY ALL)
SELECT o.o_custkey, count(*) AS lines FROM orders o JOIN n USING (o_custkey) JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey >= nx - 20 AND o_orderkey < nx GROUP BY ALL""",
    "order_status": """SELECT o_custkey, o_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) JOIN lineitem ON o_orderkey = l_orderkey WHERE rn = 1""",
    "oldest_open_order": """SELECT o_custkey, o_orderkey, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS total_cents FROM (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL) JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL""",
    "median_customer": """SELECT c_mktsegment, c_name, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_name, c_custkey) AS rn, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) WHERE rn = (n + 1) // 2""",
    "supplier_volume": """SELECT s_name, sum(l_quantity * round(p_retailprice * 100))::BIGINT AS volume_cents FROM region JOIN nation ON r_regionkey = n_regionkey JOIN supplier ON n_nationkey = s_nationkey JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey
WHERE r_name IN ('ASIA', 'AMERICA') GROUP BY s_name""",
    "customer_position": """SELECT c_custkey, round(c_acctbal, 2) AS cash, coalesce(v, 0)::BIGINT AS asset_cents FROM customer LEFT JOIN (SELECT o_custkey, sum(l_quantity * round(p_retailprice * 100))::BIGINT AS v FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL) ON o_custkey = c_custkey""",
    "market_change": """WITH s AS (SELECT p_brand, sum(l_quantity * round(p_retailprice * 100))::BIGINT AS new, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS old FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)
SELECT p_brand, round(CASE WHEN old = 0 THEN 0 ELSE 100.0::DOUBLE * (new::DOUBLE / old - 1) END, 6) AS change FROM s""",
    "part_detail": """SELECT r_name, sn.n_name AS supplier_nation, cn.n_name AS customer_nation, count(*) AS lines FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN region ON sn.n_regionkey = r_regionkey
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey GROUP BY ALL""",
    "first_lines": """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS rn FROM lineitem),
s AS (SELECT l_orderkey AS k, max(l_shipdate) AS d FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT o_orderkey, l_linenumber, l_partkey, strftime(d, '%Y-%m-%d') AS returned FROM t JOIN orders ON l_orderkey = o_orderkey LEFT JOIN s ON k = o_orderkey AND o_orderstatus = 'F' WHERE rn <= 3""",
    "order_history": "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn <= 50",
    "next_order_lines": """SELECT o_custkey, o_orderkey, count(*) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01') JOIN lineitem ON o_orderkey = l_orderkey WHERE rn = 1 GROUP BY ALL""",
    "tier_lookup": """WITH t(f, lo, hi, rate) AS (VALUES ('A', 0, 15, 1.0::DOUBLE), ('A', 15, 35, 0.9), ('A', 30, 60, 0.8), ('N', 0, 25, 1.1), ('N', 25, 60, 0.7), ('R', 0, 60, 0.5)),
j AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, arg_min(rate, lo) AS rate FROM lineitem JOIN t ON f = l_returnflag AND lo < l_quantity AND l_quantity <= hi GROUP BY ALL) SELECT rate, count(*) AS lines FROM j GROUP BY rate""",
    "lots_fifo": _lots_sql("ASC"),
    "lots_lifo": _lots_sql("DESC"),
    "feed_triggers": """WITH q(event_type, quote) AS (VALUES ('view', 20.0::DOUBLE), ('click', 40.0), ('purchase', 60.0), ('signup', 30.0), ('error', 10.0)),
j AS (SELECT event_id, value, quote, CASE event_id % 3 WHEN 0 THEN 'TSL' WHEN 1 THEN 'TLS' ELSE 'TLB' END AS kind FROM events JOIN q USING (event_type) WHERE value IS NOT NULL)
SELECT event_id, kind FROM j WHERE (kind IN ('TSL', 'TLB') AND value >= quote) OR (kind = 'TLS' AND value <= quote)""",
    "range_assets": """SELECT c_custkey, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS asset_cents FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE c_custkey >= 1 AND c_custkey < (SELECT max(c_custkey) // 10 FROM customer) GROUP BY ALL""",
    "rate_sum": """WITH r AS (SELECT n_regionkey, count(*) AS r FROM nation GROUP BY ALL), g AS (SELECT o_custkey, sum(round(o_totalprice * 100)::BIGINT)::BIGINT - 30000000 AS gain FROM orders GROUP BY ALL)
SELECT c_custkey, CASE WHEN gain > 0 THEN gain * r ELSE 0 END AS amount FROM customer JOIN nation n ON c_nationkey = n_nationkey JOIN r ON r.n_regionkey = n.n_regionkey JOIN g ON o_custkey = c_custkey""",
    "permission_probe": """WITH u AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') SELECT c_mktsegment, o_custkey IS NOT NULL AS urgent, count(*) AS n FROM customer LEFT JOIN u ON o_custkey = c_custkey GROUP BY ALL""",
    "stale_index_rows": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 7 <> 0",
    "weighted_draws": """WITH p AS (SELECT p_partkey, p_size, sum(p_size) OVER (ORDER BY p_partkey) AS hi FROM part), dr AS (SELECT range AS draw, (range * 7919 + 17) % (SELECT sum(p_size)::BIGINT FROM part) AS pos FROM range(100))
SELECT draw, p_partkey FROM dr JOIN p ON pos < hi AND pos >= hi - p_size""",
    "running_share": """SELECT o_custkey, o_orderkey, count(*) OVER w AS nth, (sum(round(o_totalprice * 100)::BIGINT) OVER w)::BIGINT AS so_far_cents FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)""",
    "toggle_names": """SELECT p_partkey, CASE WHEN contains(p_brand, 'Brand#1') THEN replace(p_brand, 'Brand#1', 'B1#') WHEN contains(p_brand, 'B1#') THEN replace(p_brand, 'B1#', 'Brand#1') ELSE p_brand END AS brand,
  p_type || ' ' || p_size::VARCHAR || ' Shares of ' || p_name AS phrase, lpad(p_partkey::VARCHAR, 10, '0') AS key FROM part""",
    "bit_functions": f"SELECT p_partkey, CASE WHEN {_BITS} >= 9223372036854775808::HUGEINT THEN {_BITS} - 18446744073709551616::HUGEINT ELSE {_BITS} END::BIGINT AS reversed, p_partkey AS back FROM part",
    "snapshot_asof": """WITH m AS (SELECT ((epoch_us(min(ts)) + epoch_us(max(ts))) / 2)::DOUBLE AS mid FROM events),
v AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events, m WHERE epoch_us(ts) <= floor(mid)) SELECT user_id, event_id FROM v WHERE rn = 1 AND event_type <> 'error'""",
    "key_range_scan": """SELECT o_custkey, o_orderkey, 'up' AS way FROM orders WHERE o_custkey >= 10 AND (o_custkey < 40 OR (o_custkey = 40 AND o_orderkey < 500)) AND o_orderkey >= 0
UNION ALL SELECT o_custkey, o_orderkey, 'down' AS way FROM orders WHERE (o_custkey > 10 OR (o_custkey = 10 AND o_orderkey > 0)) AND (o_custkey < 40 OR (o_custkey = 40 AND o_orderkey <= 500))""",
    "ycsb_read": "SELECT range AS op, (range * 2654435761) % (SELECT count(*) FROM part) + 1 AS y_key, p_name AS y_value FROM range(1000) LEFT JOIN part ON p_partkey = (range * 2654435761) % (SELECT count(*) FROM part) + 1",
    "ycsb_rmw": """WITH w AS (SELECT (range * 2654435761) % (SELECT count(*) FROM part) + 1 AS k, count(*) AS n FROM range(1000) GROUP BY ALL) SELECT p_partkey AS y_key, CASE WHEN n IS NULL THEN p_name ELSE p_name || '+' || n::VARCHAR END AS y_value FROM part LEFT JOIN w ON k = p_partkey""",
    "unique_sizes": "SELECT DISTINCT p_size AS value FROM part",
    "combined_cells": """SELECT coalesce(c.k, s.k) AS idx, coalesce(c.n, 0) + coalesce(s.n, 0) AS value
FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY ALL) c FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY ALL) s ON c.k = s.k""",
    "consecutive_parts": "SELECT a.p_partkey AS start, count(*) AS found, sum(b.p_size)::BIGINT AS total FROM part a JOIN part b ON b.p_partkey BETWEEN a.p_partkey AND a.p_partkey + 9 WHERE a.p_partkey % 100 = 0 GROUP BY ALL",
    "search_statistics": """WITH r AS (SELECT *, start_vertex IS NOT NULL AS fine, CASE WHEN elapsed_s > 0 AND start_vertex IS NOT NULL THEN elapsed_s END AS s FROM (
  SELECT *, row_number() OVER (PARTITION BY nv_scale ORDER BY run_id) AS n FROM bfs_run) WHERE n > 1)
SELECT nv_scale, count(*) AS runs, count(*) FILTER (fine) AS done, count(*) FILTER (NOT fine) AS failed, round(avg(s), 6) AS mean_s, round(min(s), 6) AS min_s, round(max(s), 6) AS max_s,
  round(count(s) / sum(s / pow(2.0::DOUBLE, nv_scale)), 3) AS rate FROM r GROUP BY nv_scale""",
    "restocked": """SELECT l_partkey, l_suppkey, CASE WHEN q < 15 THEN q + 50 ELSE q END AS quantity FROM (SELECT l_partkey, l_suppkey, min(l_quantity)::INT AS q FROM lineitem GROUP BY ALL)""",
}
