"""Write workloads as batch transforms: transactions x state tables -> new state tables.

A batch is applied as one job. Within a batch, effects on one key combine (sums, latest, running
order), which equals running its transactions one after another in ``txn_id`` order.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import scalars
from quarry.operators import scans
from quarry.session import Scratch, broadcast_if_small, load

Tables = dict[str, DataFrame]


def new_orders(state: Tables, orders: DataFrame) -> Tables:
    """``orders(txn_id, w_id, d_id, c_id, lines ARRAY<STRUCT<i_id, supply_w_id, quantity>>)``.

    Order numbers follow each district's counter in txn order; stock falls by the summed quantities
    and is raised in steps of 91 while a sale would leave less than 10.
    """
    seq = F.row_number().over(Window.partitionBy("w_id", "d_id").orderBy("txn_id"))
    d = state["district"].select(F.col("d_w_id").alias("w_id"), F.col("d_id"), F.col("d_next_o_id"))
    placed = orders.join(d, ["w_id", "d_id"]).withColumn("o_id", F.col("d_next_o_id") + seq - 1).drop("d_next_o_id")
    lines = placed.select("txn_id", "w_id", "d_id", "o_id", "c_id", F.posexplode("lines").alias("n", "l")).select("txn_id", "w_id", "d_id", "o_id", F.col("n").alias("n"), "l.i_id", "l.supply_w_id", "l.quantity")
    priced = lines.join(state["item"].select("i_id", "i_price"), "i_id")
    order_line = priced.select(F.col("w_id").alias("ol_w_id"), F.col("d_id").alias("ol_d_id"), F.col("o_id").cast("int").alias("ol_o_id"), (F.col("n") + 1).alias("ol_number"), F.col("i_id").alias("ol_i_id"), F.lit(0).cast("long").alias("ol_delivery_d"), (F.col("quantity") * F.col("i_price")).cast("float").alias("ol_amount"), F.col("supply_w_id").alias("ol_supply_w_id"), F.col("quantity").alias("ol_quantity"))
    oorder = placed.select(F.col("w_id").alias("o_w_id"), F.col("d_id").alias("o_d_id"), F.col("o_id").cast("int").alias("o_id"), F.col("c_id").alias("o_c_id"), F.lit(0).alias("o_carrier_id"), F.size("lines").alias("o_ol_cnt"), (~F.exists("lines", lambda x: x["supply_w_id"] != F.col("w_id"))).alias("o_all_local"), F.col("txn_id").cast("long").alias("o_entry_d"))
    new_order = placed.select(F.col("w_id").alias("no_w_id"), F.col("d_id").alias("no_d_id"), F.col("o_id").cast("int").alias("no_o_id"))
    # Stock falls by each quantity and is raised by 91 whenever it would end below 10: after any number
    # of sales of at most 91 it is what the sum alone tells, so sales combine map-side.
    sold = lines.groupBy(F.col("supply_w_id").alias("s_w_id"), F.col("i_id").alias("s_i_id")).agg(F.sum("quantity").alias("y"), F.count(F.lit(1)).alias("k"), F.sum((F.col("supply_w_id") != F.col("w_id")).cast("int")).alias("r"))
    left = F.col("s_quantity") - F.coalesce("y", F.lit(0))
    after = F.when(F.col("y").isNull() | (left >= 10), left).otherwise(10 + F.pmod(left - 10, F.lit(91)))
    s2 = state["stock"].join(sold, ["s_w_id", "s_i_id"], "left")
    stock = s2.select(
        "s_w_id", "s_i_id", after.cast("int").alias("s_quantity"), (F.col("s_ytd") + F.coalesce("y", F.lit(0))).cast("float").alias("s_ytd"),
        (F.col("s_order_cnt") + F.coalesce("k", F.lit(0))).cast("int").alias("s_order_cnt"), (F.col("s_remote_cnt") + F.coalesce("r", F.lit(0))).cast("int").alias("s_remote_cnt"),
    )
    count = orders.groupBy(F.col("w_id").alias("d_w_id"), "d_id").agg(F.count(F.lit(1)).alias("__k"))
    district = state["district"].join(count, ["d_w_id", "d_id"], "left").withColumn("d_next_o_id", (F.col("d_next_o_id") + F.coalesce("__k", F.lit(0))).cast("int")).drop("__k")
    return state | {"district": district.select(*state["district"].columns), "stock": stock, "oorder": state["oorder"].unionByName(oorder), "new_order": state["new_order"].unionByName(new_order), "order_line": state["order_line"].unionByName(order_line)}


def payments(state: Tables, pays: DataFrame) -> Tables:
    """``pays(txn_id, w_id, d_id, c_id, c_last, amount)``: a null c_id names the customer by last name,
    the middle one by first name. Balances fall, year-to-date sums rise; marked customers get a note
    put before their data."""
    c = state["customer"]
    mid = scans.median_row(c, ["c_w_id", "c_d_id", "c_last"], [F.col("c_first"), F.col("c_id")]).select("c_w_id", "c_d_id", "c_last", F.col("c_id").alias("by_name"))
    p = pays.withColumnsRenamed({"w_id": "c_w_id", "d_id": "c_d_id"}).join(mid, ["c_w_id", "c_d_id", "c_last"], "left").withColumn("c_id", F.coalesce("c_id", "by_name")).where("c_id is not null")
    note = scalars.clipped_join(40, F.col("c_id").cast("string"), F.col("c_d_id").cast("string"), F.col("c_w_id").cast("string"), F.format_number("amount", 2))
    keys = ["c_w_id", "c_d_id", "c_id"]
    sums = p.groupBy(*keys).agg(F.sum("amount").alias("a"), F.count(F.lit(1)).alias("k"))
    # The note field holds 300 characters and a note ten at least: of a busy customer the latest notes count.
    latest = scans.first_per_group(p.withColumn("note", note).select(*keys, "txn_id", "note"), keys, [F.desc("txn_id")], 28)
    notes = latest.groupBy(*keys).agg(F.concat_ws("|", F.transform(F.sort_array(F.collect_list(F.struct("txn_id", "note")), asc=False), lambda x: x["note"])).alias("notes"))
    by = sums.join(notes, keys)
    j = c.join(by, ["c_w_id", "c_d_id", "c_id"], "left")
    paid = F.coalesce("a", F.lit(0.0))
    customer = j.withColumns({"c_balance": (F.col("c_balance") - paid).cast("float"), "c_ytd_payment": (F.col("c_ytd_payment") + paid).cast("float"), "c_payment_cnt": (F.col("c_payment_cnt") + F.coalesce("k", F.lit(0))).cast("int"), "c_data": F.when((F.col("c_credit") == "BC") & F.col("notes").isNotNull(), F.substring(F.concat_ws("|", "notes", "c_data"), 1, 300)).otherwise(F.col("c_data"))}).select(*c.columns)
    total = lambda *k: p.groupBy(*k).agg(F.sum("amount").alias("__a"))
    w = state["warehouse"].join(total(F.col("c_w_id").alias("w_id")), "w_id", "left").withColumn("w_ytd", (F.col("w_ytd") + F.coalesce("__a", F.lit(0.0))).cast("float")).select(*state["warehouse"].columns)
    d = state["district"].join(total(F.col("c_w_id").alias("d_w_id"), F.col("c_d_id").alias("d_id")), ["d_w_id", "d_id"], "left").withColumn("d_ytd", (F.col("d_ytd") + F.coalesce("__a", F.lit(0.0))).cast("float")).select(*state["district"].columns)
    history = p.select(F.col("c_id").alias("h_c_id"), F.col("c_d_id").alias("h_c_d_id"), F.col("c_w_id").alias("h_c_w_id"), F.col("c_d_id").alias("h_d_id"), F.col("c_w_id").alias("h_w_id"), F.col("txn_id").cast("long").alias("h_date"), F.col("amount").cast("float").alias("h_amount"))
    old = state.get("history")
    return state | {"customer": customer, "warehouse": w, "district": d, "history": old.unionByName(history, allowMissingColumns=True) if old is not None else history}


def deliveries(state: Tables, carrier: int, at: int) -> Tables:
    """Delivers the oldest open order of every district: it leaves new_order, gets carrier and date, and
    its total is added to the customer's balance."""
    first = state["new_order"].groupBy("no_w_id", "no_d_id").agg(F.min("no_o_id").alias("no_o_id"))
    keys = first.select(F.col("no_w_id").alias("o_w_id"), F.col("no_d_id").alias("o_d_id"), F.col("no_o_id").alias("o_id"), F.lit(True).alias("__hit"))
    o = state["oorder"].join(keys, ["o_w_id", "o_d_id", "o_id"], "left")
    l = state["order_line"].join(keys.withColumnsRenamed({"o_w_id": "ol_w_id", "o_d_id": "ol_d_id", "o_id": "ol_o_id"}), ["ol_w_id", "ol_d_id", "ol_o_id"], "left")
    total = l.where("__hit").groupBy(F.col("ol_w_id").alias("o_w_id"), F.col("ol_d_id").alias("o_d_id"), F.col("ol_o_id").alias("o_id")).agg(F.sum("ol_amount").alias("t"))
    due = o.where("__hit").join(total, ["o_w_id", "o_d_id", "o_id"]).groupBy(F.col("o_w_id").alias("c_w_id"), F.col("o_d_id").alias("c_d_id"), F.col("o_c_id").alias("c_id")).agg(F.sum("t").alias("t"), F.count(F.lit(1)).alias("k"))
    c = state["customer"].join(due, ["c_w_id", "c_d_id", "c_id"], "left").withColumns({"c_balance": (F.col("c_balance") + F.coalesce("t", F.lit(0.0))).cast("float"), "c_delivery_cnt": (F.col("c_delivery_cnt") + F.coalesce("k", F.lit(0))).cast("int")}).select(*state["customer"].columns)
    return state | {
        "new_order": scans.remove(state["new_order"], first, ["no_w_id", "no_d_id", "no_o_id"]),
        "oorder": o.withColumn("o_carrier_id", F.when(F.col("__hit"), carrier).otherwise(F.col("o_carrier_id"))).select(*state["oorder"].columns),
        "order_line": l.withColumn("ol_delivery_d", F.when(F.col("__hit"), F.lit(at).cast("long")).otherwise(F.col("ol_delivery_d"))).select(*state["order_line"].columns),
        "customer": c,
    }


def replay(state: Tables, log: DataFrame, apply) -> Tables:
    """Applies a log again in its order: ``apply(kind, state, rows)`` for every run of one kind.

    Rows without a txn_id or kind are skipped. Each task reports where the kind changes in its range
    of the log; what comes to the driver is a row per run (and task), and each run is a batch.
    """

    def borders(batches):
        last, first = None, True
        for b in batches:
            for t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if first or k != last:
                    yield pa.record_batch({"txn_id": [t], "kind": [k]})
                last, first = k, False

    rows = log.where("txn_id is not null and kind is not null")
    runs: list[tuple[int, str]] = []
    for r in sorted(rows.select(F.col("txn_id").cast("long"), "kind").repartitionByRange("txn_id").sortWithinPartitions("txn_id", "kind").mapInArrow(borders, "txn_id long, kind string").collect()):
        if not runs or runs[-1][1] != r["kind"]:
            runs.append((r["txn_id"], r["kind"]))
    for k, (at, kind) in enumerate(runs):
        end = F.col("txn_id") <= runs[k + 1][0] if k + 1 < len(runs) else F.lit(True)
        state = apply(kind, state, rows.where((F.col("txn_id") >= at) & end & (F.col("kind") == kind)))
    return state


def market_feed(state: Tables, ticks: DataFrame) -> Tables:
    """``ticks(seq, symbol, price, quantity)``: the last tick per symbol becomes its last trade, volumes add
    up; pending requests leave the request table and are submitted at the first tick that sets them
    off (ticks that only pass a limit on the way count like the last one)."""
    last = ticks.groupBy("symbol").agg(F.max(F.struct("seq", "price")).alias("m"), F.sum("quantity").alias("v")).select(F.col("symbol").alias("lt_s_symb"), F.col("m.price").alias("p"), F.col("m.seq").alias("s"), "v")
    lt = state["last_trade"]
    new = lt.join(last, "lt_s_symb", "left").withColumns({"lt_price": F.coalesce("p", "lt_price"), "lt_dts": F.coalesce(F.col("s").cast("long"), "lt_dts"), "lt_vol": (F.col("lt_vol") + F.coalesce("v", F.lit(0))).cast("long")}).select(*lt.columns)
    wait = state["trade_request"].select(F.col("tr_s_symb").alias("symbol"), "tr_t_id", "tr_tt_id", "tr_bid_price")
    down = scans.first_crossing(wait.where(F.col("tr_tt_id").isin("TSL", "TLB")), ticks, "symbol", "tr_bid_price", "price", "seq", False)
    up = scans.first_crossing(wait.where("tr_tt_id = 'TLS'"), ticks, "symbol", "tr_bid_price", "price", "seq", True)
    ids = down.unionByName(up).where("hit is not null").select("tr_t_id", F.col("hit").cast("long").alias("at"))
    trade = state["trade"].join(ids.withColumnRenamed("tr_t_id", "t_id"), "t_id", "left").withColumns({"t_st_id": F.when(F.col("at").isNotNull(), "SBMT").otherwise(F.col("t_st_id")), "t_dts": F.coalesce("at", "t_dts")}).select(*state["trade"].columns)
    history = ids.select(F.col("tr_t_id").alias("th_t_id"), F.lit("SBMT").alias("th_st_id"), F.col("at").alias("th_dts"))
    return state | {"last_trade": new, "trade": trade, "trade_request": scans.remove(state["trade_request"], ids, ["tr_t_id"]), "trade_history": state["trade_history"].unionByName(history)}


def settle_lots(state: Tables, trades: DataFrame) -> Tables:
    """``trades(t_id, ca_id, symbol, quantity, is_sell, price, lifo, dts)`` against signed lots.

    A sale uses up bought lots, a purchase short ones, oldest first (newest with ``lifo``); what is
    left of the quantity opens a lot of its own. Used lots shrink or vanish, the history gains a row
    per lot touched, summaries follow, and ``realised`` gains each trade's buy and sell value. Trades
    of one account and symbol run in t_id order, one per round; all others share a round.
    """
    scratch = Scratch(trades.sparkSession, "lots")
    turn = F.row_number().over(Window.partitionBy("ca_id", "symbol").orderBy("t_id"))
    todo = scratch.write(trades.withColumn("turn", turn))
    for k in range(1, (todo.agg(F.max("turn")).first()[0] or 0) + 1):
        after = _settle_round(state, todo.where(F.col("turn") == k))
        state = state | {t: scratch.write(after[t]) for t in ("holding", "holding_summary", "holding_history", "realised")}
    return state


def _settle_round(state: Tables, trades: DataFrame) -> Tables:
    h, hs = state["holding"], state["holding_summary"]
    t = trades.select(F.col("ca_id").alias("h_ca_id"), F.col("symbol").alias("h_s_symb"), "t_id", "quantity", "is_sell", "price", "lifo", "dts")
    key = ["h_ca_id", "h_s_symb"]
    usable = F.when(F.col("is_sell"), F.col("h_qty") > 0).otherwise(F.col("h_qty") < 0)
    sign = F.when(F.col("is_sell"), 1).otherwise(-1)
    back = F.when(F.col("lifo"), -1).otherwise(1)
    lots = h.join(t, key).where(usable).withColumns({"size": F.abs("h_qty"), "o1": F.col("h_dts") * back, "o2": F.col("h_t_id") * back})
    w = Window.partitionBy(*key).orderBy("o1", "o2").rowsBetween(Window.unboundedPreceding, -1)
    lots = lots.withColumn("taken", F.least("size", F.greatest(F.col("quantity") - F.coalesce(F.sum("size").over(w), F.lit(0)), F.lit(0)))).where("taken > 0")
    mine, theirs = F.sum(F.col("taken") * F.col("h_price")), F.sum(F.col("taken") * F.col("price"))
    used = lots.groupBy(*key).agg(F.sum("taken").alias("used"), F.when(F.first("is_sell"), mine).otherwise(theirs).alias("buy_value"), F.when(F.first("is_sell"), theirs).otherwise(mine).alias("sell_value"))
    done = t.join(used, key, "left").withColumn("open", F.col("quantity") - F.coalesce("used", F.lit(0)))
    opened = done.where("open > 0")
    shrunk = lots.select(*h.columns, (sign * F.col("taken")).alias("cut"))
    kept = h.join(shrunk.select("h_t_id", *key, "h_dts", "cut"), ["h_t_id", *key, "h_dts"], "left").withColumn("h_qty", (F.col("h_qty") - F.coalesce("cut", F.lit(0))).cast("int")).where("h_qty <> 0").select(*h.columns)
    fresh = opened.select(*key, F.col("dts").alias("h_dts"), F.col("t_id").alias("h_t_id"), F.col("price").alias("h_price"), (-sign * F.col("open")).cast("int").alias("h_qty"))
    history = lots.select(F.col("h_t_id").alias("hh_h_t_id"), F.col("t_id").alias("hh_t_id"), F.col("h_qty").alias("hh_before_qty"), (F.col("h_qty") - sign * F.col("taken")).cast("int").alias("hh_after_qty"))
    history = history.unionByName(opened.select(F.col("t_id").alias("hh_h_t_id"), F.col("t_id").alias("hh_t_id"), F.lit(0).alias("hh_before_qty"), (-sign * F.col("open")).cast("int").alias("hh_after_qty")))
    change = t.select(F.col("h_ca_id").alias("hs_ca_id"), F.col("h_s_symb").alias("hs_s_symb"), (-sign * F.col("quantity")).cast("int").alias("hs_qty"))
    summary = hs.unionByName(change).groupBy("hs_ca_id", "hs_s_symb").agg(F.sum("hs_qty").cast("int").alias("hs_qty")).where("hs_qty <> 0")
    values = done.select("t_id", F.coalesce("buy_value", F.lit(0.0)).alias("buy_value"), F.coalesce("sell_value", F.lit(0.0)).alias("sell_value"))
    grown = lambda name, rows: state[name].unionByName(rows) if name in state else rows
    return state | {"holding": kept.unionByName(fresh.select(*h.columns)), "holding_summary": summary, "holding_history": grown("holding_history", history), "realised": grown("realised", values)}


def trade_orders(state: Tables, orders: DataFrame) -> Tables:
    """``orders(t_id, ca_id, symbol, tt_id, is_market, quantity, bid, tier, lifo, exec_name, dts)``: new trades
    with their first history row, and a request for each that waits for its price.

    Market orders bid the last price and are submitted, others are pending at their own bid. The
    commission is quantity * price * rate / 100 of the first tier that holds the quantity (none: 0).
    Orders of an unknown account or symbol change nothing.
    """
    o = orders.join(state["customer_account"].select(F.col("ca_id"), F.col("ca_b_id")), "ca_id").join(state["last_trade"].select(F.col("lt_s_symb").alias("symbol"), "lt_price"), "symbol").join(state["security"].select(F.col("s_symb").alias("symbol"), "s_ex_id"), "symbol")
    o = o.withColumns({"price": F.when(F.col("is_market"), F.col("lt_price")).otherwise(F.col("bid")), "st": F.when(F.col("is_market"), "SBMT").otherwise("PNDG")})
    tiers = state["commission_rate"].select(F.col("cr_c_tier").alias("tier"), F.col("cr_tt_id").alias("tt_id"), F.col("cr_ex_id").alias("s_ex_id"), (F.col("cr_from_qty") - 1).alias("above"), "cr_to_qty", "cr_rate")
    rate = scans.interval_lookup(o.select("t_id", "tier", "tt_id", "s_ex_id", "quantity"), tiers, ["tier", "tt_id", "s_ex_id"], "quantity", "above", "cr_to_qty").select("t_id", "cr_rate")
    o = o.join(rate, "t_id", "left")
    t = state["trade"]
    trade = o.select(
        "t_id", F.col("dts").alias("t_dts"), F.col("st").alias("t_st_id"), F.col("tt_id").alias("t_tt_id"), F.lit(True).alias("t_is_cash"), F.col("symbol").alias("t_s_symb"), F.col("quantity").cast("int").alias("t_qty"),
        F.col("price").alias("t_bid_price"), F.col("ca_id").alias("t_ca_id"), F.col("exec_name").alias("t_exec_name"), F.lit(0.0).alias("t_trade_price"), F.lit(0.0).alias("t_chrg"),
        (F.col("quantity") * F.col("price") * F.coalesce("cr_rate", F.lit(0.0)) / 100).alias("t_comm"), F.lit(0.0).alias("t_tax"), F.col("lifo").alias("t_lifo"),
    )
    history = o.select(F.col("t_id").alias("th_t_id"), F.col("st").alias("th_st_id"), F.col("dts").alias("th_dts"))
    request = o.where("not is_market").select(F.col("symbol").alias("tr_s_symb"), F.col("ca_b_id").alias("tr_b_id"), F.col("t_id").alias("tr_t_id"), F.col("tt_id").alias("tr_tt_id"), F.col("quantity").cast("int").alias("tr_qty"), F.col("price").alias("tr_bid_price"))
    return state | {"trade": t.unionByName(trade.select(*t.columns)), "trade_history": state["trade_history"].unionByName(history), "trade_request": state["trade_request"].unionByName(request)}


def trade_results(state: Tables, results: DataFrame) -> Tables:
    """``results(t_id, price, is_sell, dts)``: submitted trades take place.

    Lots are settled (``settle_lots``), the trade and its history are completed, its broker gains a
    trade and the commission, and the account's balance changes by the amount in ``settlement``.
    Unknown trades change nothing.
    """
    t = state["trade"]
    hit = results.join(t.select("t_id", "t_ca_id", "t_s_symb", "t_qty", "t_lifo", "t_comm", "t_chrg"), "t_id")
    state = settle_lots(state, hit.select("t_id", F.col("t_ca_id").alias("ca_id"), F.col("t_s_symb").alias("symbol"), F.col("t_qty").alias("quantity"), "is_sell", "price", F.col("t_lifo").alias("lifo"), "dts"))
    trade = t.join(results.select("t_id", F.col("price").alias("__p"), F.col("dts").alias("__d")), "t_id", "left").withColumns({"t_st_id": F.when(F.col("__p").isNotNull(), "CMPT").otherwise(F.col("t_st_id")), "t_dts": F.coalesce("__d", "t_dts"), "t_trade_price": F.coalesce("__p", "t_trade_price")}).select(*t.columns)
    history = hit.select(F.col("t_id").alias("th_t_id"), F.lit("CMPT").alias("th_st_id"), F.col("dts").alias("th_dts"))
    cost = F.col("t_comm") + F.col("t_chrg")
    settlement = hit.select("t_id", "t_ca_id", F.when(F.col("is_sell"), F.col("t_qty") * F.col("price") - cost).otherwise(-(F.col("t_qty") * F.col("price") + cost)).alias("amount"))
    ca = state["customer_account"]
    moved = settlement.groupBy(F.col("t_ca_id").alias("ca_id")).agg(F.sum("amount").alias("__a"))
    account = ca.join(moved, "ca_id", "left").withColumn("ca_bal", F.col("ca_bal") + F.coalesce("__a", F.lit(0.0))).select(*ca.columns)
    b = state["broker"]
    earned = hit.join(ca.select(F.col("ca_id").alias("t_ca_id"), F.col("ca_b_id").alias("b_id")), "t_ca_id").groupBy("b_id").agg(F.count(F.lit(1)).alias("__n"), F.sum("t_comm").alias("__c"))
    broker = b.join(earned, "b_id", "left").withColumns({"b_num_trades": (F.col("b_num_trades") + F.coalesce("__n", F.lit(0))).cast("int"), "b_comm_total": F.col("b_comm_total") + F.coalesce("__c", F.lit(0.0))}).select(*b.columns)
    return state | {"trade": trade, "trade_history": state["trade_history"].unionByName(history), "customer_account": account, "broker": broker, "settlement": settlement}


def rename_executions(state: Tables, trade_ids: DataFrame, a: str = " X ", b: str = "   ") -> Tables:
    """Toggles a mark in the execution names of the listed trades."""
    t = state["trade"]
    hit = trade_ids.select(F.col("t_id"), F.lit(True).alias("__hit")).distinct()
    return state | {"trade": t.join(broadcast_if_small(hit), "t_id", "left").withColumn("t_exec_name", F.when(F.col("__hit"), scalars.toggle(F.col("t_exec_name"), a, b)).otherwise(F.col("t_exec_name"))).select(*t.columns)}


def read_modify_write(table: DataFrame, keys: DataFrame, key: str, change) -> DataFrame:
    """Every requested key once through ``change(table columns)`` -> {column: expression}; repeated requests
    are passed as ``__k``, their number."""
    times = keys.groupBy(key).agg(F.count(F.lit(1)).alias("__k"))
    j = table.join(times, key, "left")
    return j.withColumns({c: F.when(F.col("__k").isNotNull(), e).otherwise(F.col(c)) for c, e in change().items()}).select(*table.columns)


def _orders_batch(spark, d) -> DataFrame:
    l = load(spark, d, "lineitem")
    lines = l.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.pmod("l_partkey", F.lit(50)).cast("int").alias("i_id"), F.lit(1).alias("supply_w_id"), F.col("l_quantity").cast("int").alias("quantity")))).alias("lines"))
    o = load(spark, d, "orders")
    return o.join(lines, o["o_orderkey"] == lines["l_orderkey"]).select(F.col("o_orderkey").alias("txn_id"), F.lit(1).alias("w_id"), (F.pmod("o_custkey", F.lit(10)) + 1).cast("int").alias("d_id"), F.col("o_custkey").cast("int").alias("c_id"), "lines")


def _store(spark) -> Tables:
    s: Tables = {
        "district": spark.createDataFrame([(1, k, 3000 + k) for k in range(1, 11)], "d_w_id int, d_id int, d_next_o_id int"),
        "item": spark.createDataFrame([(k, float(k) / 4) for k in range(50)], "i_id int, i_price float"),
        "stock": spark.createDataFrame([(1, k, 60 + k, 0.0, 0, 0) for k in range(50)], "s_w_id int, s_i_id int, s_quantity int, s_ytd float, s_order_cnt int, s_remote_cnt int"),
    }
    from quarry import schemas

    return s | {t: spark.createDataFrame([], schemas.ORDER_ENTRY[t]) for t in ("oorder", "new_order", "order_line")}


def batch_new_orders(spark: SparkSession, d: str) -> DataFrame:
    """All orders as one batch: district counters after it."""
    return new_orders(_store(spark), _orders_batch(spark, d))["district"].select("d_id", "d_next_o_id")


def batch_order_lines(spark: SparkSession, d: str) -> DataFrame:
    """The same batch: per district the lines and the amount."""
    l = new_orders(_store(spark), _orders_batch(spark, d))["order_line"]
    return l.groupBy("ol_d_id").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("ol_o_id").alias("orders"), F.sum((F.col("ol_amount") * 4).cast("long")).alias("quarter_units"))


def batch_feed(spark: SparkSession, d: str) -> DataFrame:
    """Events as a ticker: last price and volume per kind."""
    t = load(spark, d, "events").where("value is not null").select(F.col("event_id").alias("seq"), F.col("event_type").alias("symbol"), F.round("value", 4).alias("price"), F.lit(1).alias("quantity"))
    from quarry import schemas

    state = {k: spark.createDataFrame([], schemas.BROKERAGE[k]) for k in ("trade", "trade_request", "trade_history")}
    state["last_trade"] = spark.createDataFrame([(s, 0, 0.0, 0.0, 0) for s in ("view", "click", "signup", "purchase", "error", "none")], schemas.BROKERAGE["last_trade"])
    return market_feed(state, t)["last_trade"].select("lt_s_symb", "lt_dts", "lt_price", "lt_vol")


def batch_stock(spark: SparkSession, d: str) -> DataFrame:
    """The same batch: the stock after it."""
    return new_orders(_store(spark), _orders_batch(spark, d))["stock"].select("s_i_id", "s_quantity", F.col("s_ytd").cast("long").alias("s_ytd"), "s_order_cnt", "s_remote_cnt")


def batch_trade_orders(spark: SparkSession, d: str) -> DataFrame:
    """All orders as trade orders on twenty symbols: every trade, history row and request after them."""
    from quarry import schemas

    state = {k: spark.createDataFrame([], schemas.BROKERAGE[k]) for k in ("trade", "trade_request", "trade_history")}
    state["customer_account"] = load(spark, d, "customer").select(F.col("c_custkey").alias("ca_id"), F.col("c_nationkey").cast("long").alias("ca_b_id"))
    state["last_trade"] = spark.range(20).select(F.format_string("S%02d", "id").alias("lt_s_symb"), (F.col("id") + 10).cast("double").alias("lt_price"))
    state["security"] = state["last_trade"].select(F.col("lt_s_symb").alias("s_symb"), F.lit("X").alias("s_ex_id"))
    kinds = ("TMB", "TMS", "TSL", "TLS", "TLB")
    state["commission_rate"] = spark.createDataFrame([(1, k, "X", a, b, r) for k in kinds for a, b, r in ((1, 100, 3.0), (101, 500, 2.0), (501, 800, 1.0))], schemas.BROKERAGE["commission_rate"])
    tt = F.element_at(F.array(*map(F.lit, kinds)), (F.col("o_custkey") % 5 + 1).cast("int"))
    o = load(spark, d, "orders").select(
        F.col("o_orderkey").alias("t_id"), F.col("o_custkey").alias("ca_id"), F.format_string("S%02d", F.col("o_orderkey") % 25).alias("symbol"), tt.alias("tt_id"), (F.col("o_custkey") % 5 < 2).alias("is_market"),
        (F.col("o_orderkey") % 900 + 1).cast("int").alias("quantity"), F.floor("o_totalprice").cast("double").alias("bid"), F.lit(1).alias("tier"), F.lit(False).alias("lifo"), F.lit("x").alias("exec_name"), F.col("o_orderkey").alias("dts"),
    )
    s = trade_orders(state, o)
    out = s["trade"].select(F.lit("trade").alias("tbl"), "t_id", F.col("t_st_id").alias("st"), F.col("t_bid_price").alias("price"), F.round("t_comm", 4).alias("comm"))
    out = out.unionByName(s["trade_history"].select(F.lit("history").alias("tbl"), F.col("th_t_id").alias("t_id"), F.col("th_st_id").alias("st"), F.lit(0.0).alias("price"), F.lit(0.0).alias("comm")))
    return out.unionByName(s["trade_request"].select(F.lit("request").alias("tbl"), F.col("tr_t_id").alias("t_id"), F.col("tr_tt_id").alias("st"), F.col("tr_bid_price").alias("price"), F.lit(0.0).alias("comm")))


def batch_settlement(spark: SparkSession, d: str) -> DataFrame:
    """All line items as lots of 200 positions, every third of them short, and one trade on each: what
    every table holds per position afterwards."""
    key = F.col("l_partkey") % 40 * 5 + F.col("l_suppkey") % 5
    # repeated line numbers are one lot
    l = load(spark, d, "lineitem").groupBy(key.alias("k"), "l_orderkey", "l_linenumber").agg(F.floor(F.max("l_extendedprice")).cast("double").alias("price"), F.sum(F.col("l_quantity").cast("int")).cast("int").alias("size"))
    k = F.col("k")
    h = l.select(k.alias("h_ca_id"), F.lit("S").alias("h_s_symb"), F.col("l_orderkey").alias("h_dts"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("h_t_id"), F.col("price").alias("h_price"), (F.when(k % 3 == 0, -1).otherwise(1) * F.col("size")).alias("h_qty"))
    hs = h.groupBy(F.col("h_ca_id").alias("hs_ca_id"), F.col("h_s_symb").alias("hs_s_symb")).agg(F.sum("h_qty").cast("int").alias("hs_qty"))
    k = F.col("h_ca_id")
    t = h.select("h_ca_id").distinct().select((1_000_000_000 + k).alias("t_id"), k.alias("ca_id"), F.lit("S").alias("symbol"), (2000 + k * 37).cast("int").alias("quantity"), (k % 2 == 0).alias("is_sell"), (100 + k).cast("double").alias("price"), (k % 4 < 2).alias("lifo"), F.lit(10**9).cast("long").alias("dts"))
    s = settle_lots({"holding": h, "holding_summary": hs}, t)
    lots = s["holding"].groupBy(F.col("h_ca_id").alias("k")).agg(F.count(F.lit(1)).alias("lots"), F.sum("h_qty").alias("quantity"), F.sum(F.col("h_qty") * F.col("h_price")).alias("value"))
    hist = s["holding_history"].groupBy((F.col("hh_t_id") - 1_000_000_000).alias("k")).agg(F.count(F.lit(1)).alias("touched"), F.sum(F.col("hh_after_qty") - F.col("hh_before_qty")).alias("moved"))
    return s["realised"].select((F.col("t_id") - 1_000_000_000).alias("k"), "buy_value", "sell_value").join(lots, "k", "left").join(s["holding_summary"].select(F.col("hs_ca_id").alias("k"), "hs_qty"), "k", "left").join(hist, "k", "left")


QUERIES = {f.__name__: f for f in (batch_new_orders, batch_order_lines, batch_stock, batch_feed, batch_trade_orders, batch_settlement)}

SQL = {
    "batch_new_orders": "SELECT r.k::INT AS d_id, (3000 + r.k + (SELECT count(*) FROM orders WHERE o_custkey % 10 + 1 = r.k AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)))::INT AS d_next_o_id FROM (SELECT unnest(range(1, 11)) AS k) r",
    "batch_order_lines": "SELECT (o_custkey % 10 + 1)::INT AS ol_d_id, count(*) AS lines, count(DISTINCT o_orderkey) AS orders, sum(l_quantity::INT * (l_partkey % 50))::BIGINT AS quarter_units FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL",
    "batch_feed": """SELECT s AS lt_s_symb, coalesce(max(event_id), 0)::BIGINT AS lt_dts, coalesce(arg_max(round(value, 4), event_id), 0.0) AS lt_price, count(event_id) AS lt_vol
FROM (VALUES ('view'), ('click'), ('signup'), ('purchase'), ('error'), ('none')) t(s) LEFT JOIN events ON event_type = s AND value IS NOT NULL GROUP BY s""",
    "batch_stock": """WITH l AS (
  SELECT o_orderkey AS txn, l_partkey % 50 AS i, l_quantity::INT AS q, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_partkey % 50, l_quantity::INT) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
s AS (SELECT i, list(q ORDER BY txn, n) AS qs, sum(q) AS y, count(*) AS k FROM l GROUP BY i)
SELECT r.i::INT AS s_i_id, CASE WHEN qs IS NULL THEN 60 + r.i ELSE list_reduce(list_prepend((60 + r.i)::INT, qs), lambda a, q: CASE WHEN a - q >= 10 THEN a - q ELSE a - q + 91 END) END::INT AS s_quantity,
  coalesce(y, 0)::BIGINT AS s_ytd, coalesce(k, 0)::INT AS s_order_cnt, 0::INT AS s_remote_cnt FROM (SELECT unnest(range(50)) AS i) r LEFT JOIN s ON s.i = r.i""",
    "batch_trade_orders": """WITH o AS (
  SELECT o_orderkey AS t_id, ['TMB', 'TMS', 'TSL', 'TLS', 'TLB'][o_custkey % 5 + 1] AS tt, o_custkey % 5 < 2 AS mkt, o_orderkey % 900 + 1 AS q, CASE WHEN o_custkey % 5 < 2 THEN o_orderkey % 25 + 10 ELSE floor(o_totalprice) END::DOUBLE AS price
  FROM orders WHERE o_orderkey % 25 < 20 AND o_custkey IN (SELECT c_custkey FROM customer)),
p AS (SELECT *, CASE WHEN mkt THEN 'SBMT' ELSE 'PNDG' END AS st, q * price * CASE WHEN q <= 100 THEN 3.0::DOUBLE WHEN q <= 500 THEN 2.0 WHEN q <= 800 THEN 1.0 ELSE 0.0 END / 100 AS comm FROM o)
SELECT 'trade' AS tbl, t_id, st, price, round(comm, 4) AS comm FROM p
UNION ALL SELECT 'history', t_id, st, 0.0::DOUBLE, 0.0::DOUBLE FROM p
UNION ALL SELECT 'request', t_id, tt, price, 0.0::DOUBLE FROM p WHERE NOT mkt""",
    "batch_settlement": """WITH h AS (
  SELECT l_partkey % 40 * 5 + l_suppkey % 5 AS k, l_orderkey AS dts, l_orderkey * 8 + l_linenumber AS t, floor(max(l_extendedprice))::DOUBLE AS price, sum(l_quantity::INT)::INT AS size FROM lineitem GROUP BY ALL),
w AS (SELECT *, k % 3 = 0 AS is_short, k % 2 = 0 AS sell, 2000 + k * 37 AS need, (100 + k)::DOUBLE AS px,
  coalesce(sum(size) OVER (PARTITION BY k ORDER BY CASE WHEN k % 4 < 2 THEN -dts ELSE dts END, CASE WHEN k % 4 < 2 THEN -t ELSE t END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM h),
x AS (SELECT *, CASE WHEN is_short <> sell THEN least(size, greatest(need - ahead, 0)) ELSE 0 END AS taken, CASE WHEN is_short THEN -1 ELSE 1 END AS sign FROM w),
g AS (SELECT k, any_value(sell) AS sell, any_value(need) AS need, any_value(px) AS px, any_value(sign) AS sign, sum(taken) AS used, sum(taken * price) AS mine, count(*) FILTER (taken > 0) AS touched,
  count(*) FILTER (size > taken) AS lots, sum(sign * (size - taken)) AS q, sum(sign * (size - taken) * price) AS v FROM x GROUP BY k),
f AS (SELECT *, need - used AS rest, CASE WHEN sell THEN -1 ELSE 1 END AS way FROM g)
SELECT k, (CASE WHEN sell THEN mine ELSE used * px END)::DOUBLE AS buy_value, (CASE WHEN sell THEN used * px ELSE mine END)::DOUBLE AS sell_value,
  nullif(lots + (rest > 0)::INT, 0)::BIGINT AS lots, CASE WHEN lots + (rest > 0)::INT > 0 THEN q + way * rest END::BIGINT AS quantity, CASE WHEN lots + (rest > 0)::INT > 0 THEN v + way * rest * px END::DOUBLE AS value,
  nullif(q + way * rest, 0)::INT AS hs_qty, touched + (rest > 0)::INT AS touched, (way * need)::BIGINT AS moved FROM f""",
}
