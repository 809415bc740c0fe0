"""Explicit schemas; nothing is inferred from data."""

from pyspark.sql import types as T


_TYPES = {"LONG": T.LongType(), "INT": T.IntegerType(), "SHORT": T.ShortType(), "DOUBLE": T.DoubleType(), "FLOAT": T.FloatType(), "STRING": T.StringType(), "BOOLEAN": T.BooleanType()}


def _struct(fields: str) -> T.StructType:
    """``name TYPE, ...`` as a struct; unlike Spark's parser this needs no session at import."""
    out = T.StructType()
    for field in fields.split(", "):
        name, kind = field.split(" ")
        out.add(name, T.ArrayType(_TYPES[kind[6:-1]]) if kind.startswith("ARRAY<") else _TYPES[kind])
    return out


EDGES = _struct("src LONG, dst LONG, weight DOUBLE")
PACKED_EDGES = _struct("v0 INT, v1 INT, data DOUBLE")
PARENTS = _struct("vertex LONG, parent LONG")
CELLS = _struct("idx LONG, value LONG")
DENSE_ROWS = _struct("row_id LONG, features ARRAY<DOUBLE>, label DOUBLE")
SPARSE_ROWS = _struct("row_id LONG, idx ARRAY<INT>, val ARRAY<DOUBLE>, label DOUBLE")
MATRIX_CELLS = _struct("row LONG, col INT, val DOUBLE")
POINTS = _struct("pid LONG, weight FLOAT, coord ARRAY<FLOAT>")
CENTRES = _struct("id LONG, weight DOUBLE, coord ARRAY<DOUBLE>")
USER_TABLE = _struct("y_key LONG, y_value STRING")

ORDER_ENTRY = {
    "warehouse": _struct("w_id INT, w_ytd FLOAT, w_tax FLOAT, w_name STRING"),
    "district": _struct("d_w_id INT, d_id INT, d_ytd FLOAT, d_tax FLOAT, d_next_o_id INT, d_name STRING"),
    "customer": _struct("c_w_id INT, c_d_id INT, c_id INT, c_discount FLOAT, c_credit STRING, c_last STRING, c_first STRING, c_credit_lim FLOAT, c_balance FLOAT, c_ytd_payment FLOAT, c_payment_cnt INT, c_delivery_cnt INT, c_data STRING"),
    "history": _struct("h_c_id INT, h_c_d_id INT, h_c_w_id INT, h_d_id INT, h_w_id INT, h_date LONG, h_amount FLOAT, h_data STRING"),
    "item": _struct("i_id INT, i_name STRING, i_price FLOAT, i_data STRING, i_im_id INT"),
    "new_order": _struct("no_w_id INT, no_d_id INT, no_o_id INT"),
    "oorder": _struct("o_w_id INT, o_d_id INT, o_id INT, o_c_id INT, o_carrier_id INT, o_ol_cnt INT, o_all_local BOOLEAN, o_entry_d LONG"),
    "order_line": _struct("ol_w_id INT, ol_d_id INT, ol_o_id INT, ol_number INT, ol_i_id INT, ol_delivery_d LONG, ol_amount FLOAT, ol_supply_w_id INT, ol_quantity INT"),
    "stock": _struct("s_w_id INT, s_i_id INT, s_quantity INT, s_ytd FLOAT, s_order_cnt INT, s_remote_cnt INT"),
}

BROKERAGE = {
    "customer_account": _struct("ca_id LONG, ca_b_id LONG, ca_c_id LONG, ca_name STRING, ca_tax_st SHORT, ca_bal DOUBLE"),
    "holding": _struct("h_ca_id LONG, h_s_symb STRING, h_dts LONG, h_t_id LONG, h_price DOUBLE, h_qty INT"),
    "holding_summary": _struct("hs_ca_id LONG, hs_s_symb STRING, hs_qty INT"),
    "broker": _struct("b_id LONG, b_st_id STRING, b_name STRING, b_num_trades INT, b_comm_total DOUBLE"),
    "trade": _struct("t_id LONG, t_dts LONG, t_st_id STRING, t_tt_id STRING, t_is_cash BOOLEAN, t_s_symb STRING, t_qty INT, t_bid_price DOUBLE, t_ca_id LONG, t_exec_name STRING, t_trade_price DOUBLE, t_chrg DOUBLE, t_comm DOUBLE, t_tax DOUBLE, t_lifo BOOLEAN"),
    "trade_history": _struct("th_t_id LONG, th_st_id STRING, th_dts LONG"),
    "trade_request": _struct("tr_s_symb STRING, tr_b_id LONG, tr_t_id LONG, tr_tt_id STRING, tr_qty INT, tr_bid_price DOUBLE"),
    "last_trade": _struct("lt_s_symb STRING, lt_dts LONG, lt_price DOUBLE, lt_open_price DOUBLE, lt_vol LONG"),
    "daily_market": _struct("dm_s_symb STRING, dm_date LONG, dm_close DOUBLE, dm_high DOUBLE, dm_low DOUBLE, dm_vol LONG"),
    "security": _struct("s_symb STRING, s_issue STRING, s_ex_id STRING, s_co_id LONG, s_num_out LONG, s_pe DOUBLE"),
    "company": _struct("co_id LONG, co_name STRING, co_in_id STRING"),
    "commission_rate": _struct("cr_c_tier INT, cr_tt_id STRING, cr_ex_id STRING, cr_from_qty INT, cr_to_qty INT, cr_rate DOUBLE"),
}
