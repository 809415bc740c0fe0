import random

import pytest
from pyspark.sql import functions as F

from quarry import schemas
from quarry.plans import batches as B
from quarry.sources import generators
from quarry.streaming import feeds


@pytest.fixture(scope="module")
def store(spark):
    return generators.order_entry(spark, 1, 2, 10, 20)


def test_new_orders(spark, store):
    lines = [(3, 1, 5), (3, 1, 90), (4, 2, 1)]
    orders = spark.createDataFrame([(1, 1, 1, 7, lines), (2, 1, 1, 8, [(3, 1, 1)])], "txn_id long, w_id int, d_id int, c_id int, lines array<struct<i_id:int,supply_w_id:int,quantity:int>>")
    after = B.new_orders(store, orders)
    assert after["district"].where("d_id = 1").first()["d_next_o_id"] == 13
    assert after["oorder"].where("o_id >= 11").count() == 2 and not after["oorder"].where("o_id = 11 and o_d_id = 1").first()["o_all_local"]
    q = store["stock"].where("s_i_id = 3").first()["s_quantity"]
    for sold in (5, 90, 1):
        q = q - sold if q - sold >= 10 else q - sold + 91
    got = after["stock"].where("s_i_id = 3").first()
    assert (got["s_quantity"], got["s_ytd"], got["s_order_cnt"]) == (q, 96.0, 3)


def test_payments_by_id_and_by_name(spark, store):
    c = store["customer"].where("c_d_id = 1").orderBy("c_first", "c_id").collect()
    name = c[0]["c_last"]
    same = [r for r in c if r["c_last"] == name]
    mid = same[(len(same) + 1) // 2 - 1]["c_id"]
    pays = spark.createDataFrame([(1, 1, 1, None, name, 30.0), (2, 1, 1, mid, None, 5.0), (3, 1, 1, None, "NOBODY", 9.0)], "txn_id long, w_id int, d_id int, c_id int, c_last string, amount double")
    after = B.payments(store, pays)
    r = after["customer"].where(f"c_d_id = 1 and c_id = {mid}").first()
    assert r["c_balance"] == -45.0 and r["c_payment_cnt"] == 3
    assert after["warehouse"].first()["w_ytd"] == 300035.0 and after["history"].count() == 2


def test_delivery(spark, store):
    before = store["new_order"].groupBy("no_d_id").agg(F.min("no_o_id").alias("m")).collect()
    after = B.deliveries(store, 9, 77)
    assert after["new_order"].count() == store["new_order"].count() - 2
    for r in before:
        o = after["oorder"].where(f"o_d_id = {r['no_d_id']} and o_id = {r['m']}").first()
        assert o["o_carrier_id"] == 9
        owed = after["order_line"].where(f"ol_d_id = {r['no_d_id']} and ol_o_id = {r['m']}").agg(F.sum("ol_amount")).first()[0]
        c = after["customer"].where(f"c_d_id = {r['no_d_id']} and c_id = {o['o_c_id']}").first()
        assert c["c_balance"] == pytest.approx(-10 + owed, rel=1e-5) and c["c_delivery_cnt"] == 1


def test_feed_and_lots(spark):
    s = generators.brokerage(spark, 10, 5, 300)
    ticks = spark.createDataFrame([(1, "S00001", 10.0, 5), (2, "S00001", 99.0, 5)], "seq long, symbol string, price double, quantity int")
    after = B.market_feed(s, ticks)
    r = after["last_trade"].where("lt_s_symb = 'S00001'").first()
    assert (r["lt_price"], r["lt_vol"], r["lt_dts"]) == (99.0, 10, 2)
    gone = s["trade_request"].count() - after["trade_request"].count()
    # the first tick is below every bid, the second above: each kind finds one that sets it off
    assert gone == s["trade_request"].where("tr_s_symb = 'S00001'").count() > 0
    h = s["holding_summary"].orderBy("hs_ca_id", "hs_s_symb").first()
    sales = spark.createDataFrame([(h["hs_ca_id"], h["hs_s_symb"], h["hs_qty"], 50.0)], "ca_id long, symbol string, quantity int, price double")
    trades = sales.selectExpr("99999L as t_id", "ca_id", "symbol", "quantity", "true as is_sell", "price", "false as lifo", "5L as dts")
    sold = B.settle_lots(s, trades)
    assert sold["holding"].where(f"h_ca_id = {h['hs_ca_id']} and h_s_symb = '{h['hs_s_symb']}'").count() == 0
    assert sold["realised"].first()["sell_value"] == 50.0 * h["hs_qty"]
    assert sold["holding"].count() + sold["holding_history"].count() == s["holding"].count()


def lots_one_by_one(lots, trades):
    """Signed lots {key: [(dts, id, price, qty)]} after trades in order; and (buy, sell) per trade."""
    lots = {k: list(v) for k, v in lots.items()}
    values, touched = {}, []
    for t, ca, sym, q, sell, price, lifo, dts in sorted(trades):
        mine, buy, sold = sorted(lots.get((ca, sym), []), reverse=lifo), 0.0, 0.0
        kept = []
        for d, i, p, n in mine:
            take = min(q, abs(n)) if (n > 0) == sell and q else 0
            if take:
                q -= take
                buy, sold = (buy + take * p, sold + take * price) if sell else (buy + take * price, sold + take * p)
                left = n - take if sell else n + take
                touched.append((i, t, n, left))
                n = left
            if n:
                kept.append((d, i, p, n))
        if q:
            kept.append((dts, t, price, -q if sell else q))
            touched.append((t, t, 0, -q if sell else q))
        lots[ca, sym] = kept
        values[t] = buy, sold
    return {k: sorted(v) for k, v in lots.items() if v}, values, sorted(touched)


def test_signed_lots_in_several_rounds(spark):
    rng = random.Random(6)
    lots = {(ca, sym): [(k, 100 * ca + 10 * (sym == "B") + k, float(rng.randrange(5, 20)), rng.choice([-1, 1][ca % 2 :] or [1]) * rng.randrange(1, 9)) for k in range(4)] for ca in (1, 2) for sym in "AB"}
    lots[1, "A"] = [(d, i, p, -abs(n)) for d, i, p, n in lots[1, "A"]]
    lots[2, "B"] = [(d, i, p, abs(n)) for d, i, p, n in lots[2, "B"]]
    lots = {k: [(d, i, p, abs(n) if v[0][3] > 0 else -abs(n)) for d, i, p, n in v] for k, v in lots.items()}
    trades = [(1000 + k, rng.choice([1, 2, 3]), rng.choice("AB"), rng.randrange(1, 25), rng.random() < 0.5, float(rng.randrange(5, 20)), rng.random() < 0.5, 50 + k) for k in range(12)]
    rows = [(ca, s, d, i, p, n) for (ca, s), v in lots.items() for d, i, p, n in v]
    h = spark.createDataFrame(rows, schemas.BROKERAGE["holding"])
    hs = h.groupBy(F.col("h_ca_id").alias("hs_ca_id"), F.col("h_s_symb").alias("hs_s_symb")).agg(F.sum("h_qty").cast("int").alias("hs_qty"))
    old = spark.createDataFrame([(1, 2, 3, 4)], "hh_h_t_id long, hh_t_id long, hh_before_qty int, hh_after_qty int")
    t = spark.createDataFrame(trades, "t_id long, ca_id long, symbol string, quantity int, is_sell boolean, price double, lifo boolean, dts long")
    after = B.settle_lots({"holding": h, "holding_summary": hs, "holding_history": old}, t)
    want, values, touched = lots_one_by_one(lots, trades)
    got = {}
    for r in after["holding"].collect():
        got.setdefault((r["h_ca_id"], r["h_s_symb"]), []).append((r["h_dts"], r["h_t_id"], r["h_price"], r["h_qty"]))
    assert {k: sorted(v) for k, v in got.items()} == want
    assert {r["t_id"]: (r["buy_value"], r["sell_value"]) for r in after["realised"].collect()} == values
    assert sorted(map(tuple, after["holding_history"].collect())) == sorted([(1, 2, 3, 4), *touched])
    assert {(r["hs_ca_id"], r["hs_s_symb"]): r["hs_qty"] for r in after["holding_summary"].collect()} == {k: q for k, v in want.items() if (q := sum(x[3] for x in v))}


def test_every_tick_can_set_off_a_request(spark):
    s = {k: spark.createDataFrame([], schemas.BROKERAGE[k]) for k in ("trade", "trade_history", "last_trade")}
    s["trade"] = spark.createDataFrame([(i, 0, "PNDG", k, True, "A", 1, b, 1, "x", 0.0, 0.0, 0.0, 0.0, False) for i, k, b in ((1, "TLB", 5.0), (2, "TLS", 9.0), (3, "TSL", 1.0), (4, "TLB", 7.0))], schemas.BROKERAGE["trade"])
    s["trade_request"] = s["trade"].selectExpr("t_s_symb as tr_s_symb", "1L as tr_b_id", "t_id as tr_t_id", "t_tt_id as tr_tt_id", "t_qty as tr_qty", "t_bid_price as tr_bid_price")
    ticks = spark.createDataFrame([(1, "A", 7.0, 1), (2, "A", 4.0, 1), (3, "A", 9.5, 1), (4, "A", 8.0, 1), (5, "B", 0.5, 1), (6, None, 0.5, 1)], "seq long, symbol string, price double, quantity int")
    after = B.market_feed(s, ticks)
    assert {r["th_t_id"]: r["th_dts"] for r in after["trade_history"].collect()} == {1: 2, 2: 3, 4: 1}
    assert [r["tr_t_id"] for r in after["trade_request"].collect()] == [3]


def test_orders_and_results(spark):
    s = generators.brokerage(spark, 10, 5, 50)
    s["commission_rate"] = spark.createDataFrame([(1, "TMS", x, 1, 1000, 2.0) for x in ("NYSE", "NASDAQ", "AMEX", "PCX")], schemas.BROKERAGE["commission_rate"])
    o = spark.createDataFrame([(900, 3, "S00001", "TMS", True, 100, 0.0, 1, False, "me", 7), (901, 3, "S00001", "TLB", False, 50, 12.5, 1, False, "me", 8), (902, 3, "NONE", "TMS", True, 1, 0.0, 1, False, "me", 9)], "t_id long, ca_id long, symbol string, tt_id string, is_market boolean, quantity int, bid double, tier int, lifo boolean, exec_name string, dts long")
    a = B.trade_orders(s, o)
    price = s["last_trade"].where("lt_s_symb = 'S00001'").first()["lt_price"]
    t = {r["t_id"]: r for r in a["trade"].where("t_id >= 900").collect()}
    assert set(t) == {900, 901} and t[900]["t_bid_price"] == price and t[900]["t_comm"] == pytest.approx(2 * price) and t[901]["t_st_id"] == "PNDG"
    assert [r["tr_t_id"] for r in a["trade_request"].where("tr_t_id >= 900").collect()] == [901]
    r = B.trade_results(a, spark.createDataFrame([(900, 20.0, True, 11), (12345, 1.0, True, 1)], "t_id long, price double, is_sell boolean, dts long"))
    row = r["trade"].where("t_id = 900").first()
    assert (row["t_st_id"], row["t_dts"], row["t_trade_price"]) == ("CMPT", 11, 20.0)
    account = lambda x: x["customer_account"].where("ca_id = 3").first()
    assert account(r)["ca_bal"] == pytest.approx(account(s)["ca_bal"] + 2000 - 2 * price)
    assert r["broker"].where(f"b_id = {account(s)['ca_b_id']}").first()["b_num_trades"] == 1
    assert r["settlement"].count() == 1 and r["trade_history"].where("th_t_id = 900").count() == 2


def test_rename_and_rmw(spark):
    s = generators.brokerage(spark, 5, 5, 20)
    ids = spark.createDataFrame([(1,), (1,)], "t_id long")
    marked = B.rename_executions(s, ids, "exec", "EXEC")["trade"]
    assert marked.where("t_exec_name like 'EXEC%'").count() == 1 and marked.count() == 20
    t = generators.user_table(spark, 4)
    keys = spark.createDataFrame([(1,), (1,), (9,)], "y_key long")
    out = {r["y_key"]: r["y_value"] for r in B.read_modify_write(t, keys, "y_key", lambda: {"y_value": F.concat("y_value", F.col("__k").cast("string"))}).collect()}
    assert out == {0: "a" * 8, 1: "a" * 8 + "2", 2: "a" * 8, 3: "a" * 8}


def test_replay_keeps_the_order_of_the_log(spark):
    log = spark.createDataFrame([(k, kind) for k, kind in enumerate("aabbbaab")] + [(None, "a"), (3, None)], "txn_id long, kind string").repartition(3)
    seen = []
    B.replay({}, log, lambda kind, st, rows: seen.append((kind, sorted(r["txn_id"] for r in rows.collect()))) or st)
    assert seen == [("a", [0, 1]), ("b", [2, 3, 4]), ("a", [5, 6]), ("b", [7])]


def test_replay(spark, store):
    log = spark.createDataFrame([(1, "pay", 1, 1, 3, 10.0), (2, "pay", 1, 2, 4, 20.0)], "txn_id long, kind string, w_id int, d_id int, c_id int, amount double").withColumn("c_last", F.lit(None).cast("string"))
    after = B.replay(store, log, lambda kind, st, rows: B.payments(st, rows))
    assert after["warehouse"].first()["w_ytd"] == 300030.0


def test_batch_feeds(spark):
    t = spark.createDataFrame([(i, f"S{i % 3}") for i in range(45)], "seq long, symbol string")
    f = feeds.feeds_of(t, lanes=1)
    assert {r["feed"]: r["count"] for r in f.groupBy("feed").count().collect()} == {0: 20, 1: 20, 2: 5}
    trig = spark.createDataFrame([(0, 1, "T")], "feed long, seq long, symbol string")
    amb = spark.createDataFrame([(0, i, "A") for i in range(30)], "feed long, seq long, symbol string")
    full = feeds.fill_feeds(trig, amb, 20)
    assert full.count() == 20 and full.where("symbol = 'T' and place = 1").count() == 1


def test_book_and_delays(spark):
    orders = spark.createDataFrame([(1, "A", "buy", 10.0, 0), (2, "A", "sell", 12.0, 0), (3, "A", "buy", 1.0, 0), (4, "A", "buy", 10.0, 6)], "order_id long, symbol string, kind string, limit double, ts int")
    quotes = spark.createDataFrame([("A", 11.0, 1), ("A", 9.0, 5), ("A", 12.5, 7)], "symbol string, price double, ts int")
    assert {r["order_id"]: r["at"] for r in feeds.book_triggers(orders, quotes).collect()} == {1: 5, 2: 7, 3: None, 4: None}
    d = feeds.due_results(spark.range(500).selectExpr("id as t_id", "0.0 as ts"), 2.0, 5.0).agg(F.min("due"), F.max("due"), F.avg("due")).first()
    assert d[0] > 0 and d[1] == 5.0 and 1.5 < d[2] < 2.2


def test_streams(spark, tmp_path):
    spark.createDataFrame([(i, "S") for i in range(45)], "seq long, symbol string").coalesce(1).write.parquet(str(tmp_path / "t"))
    src = spark.readStream.schema("seq long, symbol string").parquet(str(tmp_path / "t"))
    q = feeds.stream_feeds(src, 20, 1).writeStream.format("memory").queryName("feeds").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["feed"], len(r["symbols"])) for r in spark.table("feeds").collect()) == [(0, 20), (1, 20)]
    req = spark.createDataFrame([(7, "S", "TLS", 5.0)], "tr_t_id long, tr_s_symb string, tr_tt_id string, tr_bid_price double")
    feed = src.withColumn("price", F.col("seq").cast("double"))
    q = feeds.stream_requests(feed, req).writeStream.format("memory").queryName("fired").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("fired").count() == 40
    ev = spark.createDataFrame([("2025-01-01 00:01:00", "a", 1.0), ("2025-01-01 00:05:00", "a", 2.0)], "ts string, event_type string, value double").select(F.to_timestamp("ts").alias("ts"), "event_type", "value")
    assert [(r["n"], r["total"]) for r in feeds.event_windows(ev).collect()] == [(2, 3.0)]
