"""Seeded row generators: order entry, brokerage and key-value tables.

Every value is a hash of (table, key, seed): rows do not depend on partitioning and any slice can be
made alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The syllables of generated last names, in order.
SYLLABLES = ["BAR", "OUGHT", "ABLE", "PRI", "PRES", "ESE", "ANTI", "CALLY", "ATION", "EING"]


def draw(low: int, high: int, *key: Column | str | int) -> Column:
    """A uniform integer in low..high from a key."""
    cols = [k if isinstance(k, Column) else F.lit(k) for k in key]
    return (F.pmod(F.xxhash64(*cols), F.lit(high - low + 1)) + low).cast("int")


def skewed(a: int, low: int, high: int, c: int, *key: Column | str | int) -> Column:
    """Non-uniform draw: one draw from 0..a or-ed with one from low..high, shifted by c."""
    span = high - low + 1
    return (F.pmod(draw(0, a, *key, 1).bitwiseOR(draw(low, high, *key, 2)) + c, F.lit(span)) + low).cast("int")


def last_name(n: Column) -> Column:
    """Three syllables, by the three last digits of a number."""
    table = F.array(*map(F.lit, SYLLABLES))
    digit = lambda d: F.get(table, F.pmod(F.floor(n / d), F.lit(10)).cast("int"))
    return F.concat(digit(100), digit(10), digit(1))


def order_entry(spark: SparkSession, warehouses: int = 1, districts: int = 10, customers: int = 300, items: int = 1000, seed: int = 1) -> dict[str, DataFrame]:
    """warehouse, district, customer, item, stock, oorder, order_line and new_order."""
    w = spark.range(1, warehouses + 1).select(F.col("id").cast("int").alias("w"))
    d = w.withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(districts))))
    c = d.withColumn("c", F.explode(F.sequence(F.lit(1), F.lit(customers))))
    key = lambda t, *k: (t, seed, *k)
    W, D, C = F.col("w"), F.col("d"), F.col("c")
    warehouse = w.select(W.alias("w_id"), F.lit(300000.0).cast("float").alias("w_ytd"), (draw(0, 2000, *key("w", W)) / 10000).cast("float").alias("w_tax"), F.concat(F.lit("wh"), W.cast("string")).alias("w_name"))
    district = d.select(W.alias("d_w_id"), D.alias("d_id"), F.lit(30000.0).cast("float").alias("d_ytd"), (draw(0, 2000, *key("d", W, D)) / 10000).cast("float").alias("d_tax"), F.lit(customers + 1).alias("d_next_o_id"), F.concat(F.lit("ds"), D.cast("string")).alias("d_name"))
    customer = c.select(
        W.alias("c_w_id"), D.alias("c_d_id"), C.alias("c_id"), (draw(0, 5000, *key("disc", W, D, C)) / 10000).cast("float").alias("c_discount"),
        F.when(draw(1, 10, *key("credit", W, D, C)) == 1, "BC").otherwise("GC").alias("c_credit"), last_name(F.when(C <= 1000, C - 1).otherwise(skewed(255, 0, 999, 123, *key("last", W, D, C)))).alias("c_last"),
        F.concat(F.lit("first"), draw(0, 9999, *key("first", W, D, C)).cast("string")).alias("c_first"), F.lit(50000.0).cast("float").alias("c_credit_lim"), F.lit(-10.0).cast("float").alias("c_balance"),
        F.lit(10.0).cast("float").alias("c_ytd_payment"), F.lit(1).alias("c_payment_cnt"), F.lit(0).alias("c_delivery_cnt"), F.hex(F.xxhash64(W, D, C)).alias("c_data"),
    )
    item = spark.range(1, items + 1).select(F.col("id").cast("int").alias("i_id"), F.concat(F.lit("item"), F.col("id").cast("string")).alias("i_name"), (draw(100, 10000, *key("price", F.col("id"))) / 100).cast("float").alias("i_price"), F.when(draw(1, 10, *key("orig", F.col("id"))) == 1, F.lit("xxORIGINALxx")).otherwise(F.hex(F.xxhash64("id"))).alias("i_data"), draw(1, 10000, *key("im", F.col("id"))).alias("i_im_id"))
    stock = w.withColumn("s_i_id", F.explode(F.sequence(F.lit(1), F.lit(items))))
    stock = stock.select(W.alias("s_w_id"), "s_i_id", draw(10, 100, *key("qty", W, F.col("s_i_id"))).alias("s_quantity"), F.lit(0.0).cast("float").alias("s_ytd"), F.lit(0).alias("s_order_cnt"), F.lit(0).alias("s_remote_cnt"))
    oorder = c.select(W.alias("o_w_id"), D.alias("o_d_id"), C.alias("o_id"), draw(1, customers, *key("oc", W, D, C)).alias("o_c_id"), F.when(C <= customers * 0.7, draw(1, 10, *key("car", W, D, C))).otherwise(0).alias("o_carrier_id"), draw(5, 15, *key("cnt", W, D, C)).alias("o_ol_cnt"), F.lit(True).alias("o_all_local"), C.cast("long").alias("o_entry_d"))
    line = oorder.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("o_ol_cnt"))))
    order_line = line.select(F.col("o_w_id").alias("ol_w_id"), F.col("o_d_id").alias("ol_d_id"), F.col("o_id").alias("ol_o_id"), F.col("n").alias("ol_number"), draw(1, items, *key("oli", F.col("o_w_id"), F.col("o_d_id"), F.col("o_id"), F.col("n"))).alias("ol_i_id"), F.when(F.col("o_carrier_id") > 0, F.col("o_entry_d")).otherwise(0).alias("ol_delivery_d"), (draw(1, 999999, *key("amt", F.col("o_w_id"), F.col("o_d_id"), F.col("o_id"), F.col("n"))) / 100).cast("float").alias("ol_amount"), F.col("o_w_id").alias("ol_supply_w_id"), F.lit(5).alias("ol_quantity"))
    new_order = oorder.where("o_carrier_id = 0").select(F.col("o_w_id").alias("no_w_id"), F.col("o_d_id").alias("no_d_id"), F.col("o_id").alias("no_o_id"))
    return {"warehouse": warehouse, "district": district, "customer": customer, "item": item, "stock": stock, "oorder": oorder, "order_line": order_line, "new_order": new_order}


def brokerage(spark: SparkSession, customers: int = 100, symbols: int = 50, trades: int = 2000, seed: int = 1) -> dict[str, DataFrame]:
    """customer_account, broker, security, last_trade, trade, trade_history, holding, holding_summary, trade_request."""
    sym = lambda c: F.concat(F.lit("S"), F.lpad(c.cast("string"), 5, "0"))
    i = F.col("id")
    accounts = spark.range(customers * 3)
    customer_account = accounts.select((i + 1).alias("ca_id"), (F.pmod(i, F.lit(max(1, customers // 10))) + 1).alias("ca_b_id"), (F.floor(i / 3) + 1).alias("ca_c_id"), F.concat(F.lit("account "), i.cast("string")).alias("ca_name"), draw(0, 2, "tax", seed, i).cast("short").alias("ca_tax_st"), (draw(0, 1000000, "bal", seed, i) / 100).alias("ca_bal"))
    broker = spark.range(max(1, customers // 10)).select((i + 1).alias("b_id"), F.lit("ACTV").alias("b_st_id"), F.concat(F.lit("broker "), i.cast("string")).alias("b_name"), F.lit(0).alias("b_num_trades"), F.lit(0.0).alias("b_comm_total"))
    security = spark.range(symbols).select(sym(i).alias("s_symb"), F.lit("COMMON").alias("s_issue"), F.element_at(F.array(F.lit("NYSE"), F.lit("NASDAQ"), F.lit("AMEX"), F.lit("PCX")), draw(1, 4, "ex", seed, i)).alias("s_ex_id"), (i + 1).alias("s_co_id"), draw(1000, 100000, "out", seed, i).cast("long").alias("s_num_out"), (draw(100, 5000, "pe", seed, i) / 100).alias("s_pe"))
    last_trade = spark.range(symbols).select(sym(i).alias("lt_s_symb"), F.lit(0).cast("long").alias("lt_dts"), (draw(2000, 3000, "lt", seed, i) / 100).alias("lt_price"), (draw(2000, 3000, "lo", seed, i) / 100).alias("lt_open_price"), F.lit(0).cast("long").alias("lt_vol"))
    kinds = F.array(*map(F.lit, ["TMB", "TMS", "TSL", "TLS", "TLB"]))
    trade = spark.range(trades).select(
        (i + 1).alias("t_id"), (i * 1000).alias("t_dts"), F.when(draw(1, 20, "st", seed, i) == 1, "PNDG").otherwise("CMPT").alias("t_st_id"), F.get(kinds, draw(0, 4, "tt", seed, i)).alias("t_tt_id"), (draw(0, 1, "cash", seed, i) == 1).alias("t_is_cash"),
        sym(draw(0, symbols - 1, "sy", seed, i)).alias("t_s_symb"), (draw(1, 8, "q", seed, i) * 100).alias("t_qty"), (draw(2000, 3000, "bid", seed, i) / 100).alias("t_bid_price"), draw(1, customers * 3, "ca", seed, i).cast("long").alias("t_ca_id"), F.concat(F.lit("exec "), i.cast("string")).alias("t_exec_name"),
        (draw(2000, 3000, "tp", seed, i) / 100).alias("t_trade_price"), F.lit(1.0).alias("t_chrg"), F.lit(0.5).alias("t_comm"), F.lit(0.0).alias("t_tax"), (draw(0, 1, "lifo", seed, i) == 1).alias("t_lifo"),
    )
    bought = trade.where("t_st_id = 'CMPT' and t_tt_id in ('TMB', 'TLB')")
    holding = bought.select(F.col("t_ca_id").alias("h_ca_id"), F.col("t_s_symb").alias("h_s_symb"), F.col("t_dts").alias("h_dts"), F.col("t_id").alias("h_t_id"), F.col("t_trade_price").alias("h_price"), F.col("t_qty").alias("h_qty"))
    holding_summary = holding.groupBy(F.col("h_ca_id").alias("hs_ca_id"), F.col("h_s_symb").alias("hs_s_symb")).agg(F.sum("h_qty").cast("int").alias("hs_qty"))
    history = trade.select(F.col("t_id").alias("th_t_id"), F.explode(F.when(F.col("t_st_id") == "CMPT", F.array(F.lit("SBMT"), F.lit("CMPT"))).otherwise(F.array(F.lit("PNDG")))).alias("th_st_id"), "t_dts").select("th_t_id", "th_st_id", (F.col("t_dts") + F.when(F.col("th_st_id") == "CMPT", 500).otherwise(0)).alias("th_dts"))
    request = trade.where("t_st_id = 'PNDG' and t_tt_id in ('TSL', 'TLS', 'TLB')").select(F.col("t_s_symb").alias("tr_s_symb"), F.lit(1).cast("long").alias("tr_b_id"), F.col("t_id").alias("tr_t_id"), F.col("t_tt_id").alias("tr_tt_id"), F.col("t_qty").alias("tr_qty"), F.col("t_bid_price").alias("tr_bid_price"))
    return {"customer_account": customer_account, "broker": broker, "security": security, "last_trade": last_trade, "trade": trade, "trade_history": history, "holding": holding, "holding_summary": holding_summary, "trade_request": request}


def user_table(spark: SparkSession, n: int) -> DataFrame:
    """Keys 0..n-1, each with the same eight-character value."""
    return spark.range(n).select(F.col("id").alias("y_key"), F.lit("aaaaaaaa").alias("y_value"))


def transaction_mix(spark: SparkSession, n: int, weights: dict[str, float], seed: int = 1) -> DataFrame:
    """``txn_id, kind``: n transactions, each kind by its share of the weights."""
    total = sum(weights.values())
    x = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) / 1_000_000 * total
    acc, kind = 0.0, None
    for name, w in weights.items():
        acc += w
        kind = F.when(x < acc, name) if kind is None else kind.when(x < acc, name)
    return spark.range(n).select(F.col("id").alias("txn_id"), kind.otherwise(list(weights)[-1]).alias("kind"))
