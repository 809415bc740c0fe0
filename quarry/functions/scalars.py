"""Scalar functions as column expressions; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def log_loss(score: Column, label: Column) -> Column:
    """-y d + log(1 + e^d), written so that a large score does not overflow."""
    return F.greatest(score, F.lit(0.0)) - label * score + F.log1p(F.exp(-F.abs(score)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def sparse_dot(idx: Column, val: Column, model: Column) -> Column:
    """Sum of val * model[idx]; indices outside the model count as 0."""
    return F.aggregate(F.zip_with(idx, val, lambda i, v: v * F.coalesce(F.get(model, i), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def squared_loss(score: Column, label: Column) -> Column:
    return 0.5 * (score - label) * (score - label)


def hinge_loss(score: Column, label: Column) -> Column:
    """max(0, 1 - y d) for labels -1 and +1."""
    return F.greatest(F.lit(0.0), 1 - label * score)


def reverse_bits(x: Column) -> Column:
    """64-bit reversal by swapping ever smaller halves."""
    for shift, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        m = F.lit(mask)
        x = F.shiftrightunsigned(x, shift).bitwiseAND(m).bitwiseOR(F.shiftleft(x.bitwiseAND(m), shift))
    return F.shiftrightunsigned(x, 32).bitwiseOR(F.shiftleft(x, 32))


def swap_bytes(x: Column) -> Column:
    for shift, mask in ((8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        m = F.lit(mask)
        x = F.shiftrightunsigned(x, shift).bitwiseAND(m).bitwiseOR(F.shiftleft(x.bitwiseAND(m), shift))
    return F.shiftrightunsigned(x, 32).bitwiseOR(F.shiftleft(x, 32))


def padded_key(x: Column, width: int) -> Column:
    return F.lpad(x.cast("string"), width, "0")


def toggle(s: Column, a: str, b: str) -> Column:
    """The first occurrence of a becomes b; without one, the first of b becomes a."""

    def swap(frm: str, to: str) -> Column:
        at = F.instr(s, frm)
        return F.concat(F.substr(s, F.lit(1), at - 1), F.lit(to), F.substr(s, at + len(frm)))

    return F.when(s.contains(a), swap(a, b)).when(s.contains(b), swap(b, a)).otherwise(s)


def percent_change(old: Column, new: Column) -> Column:
    """100 (new / old - 1); 0 where old is 0."""
    return F.when(old == 0, F.lit(0.0)).otherwise(100 * (new.cast("double") / old.cast("double") - 1))


def triggered(kind: Column, bid: Column, quote: Column) -> Column:
    """Stop-loss and limit-buy fire at bid >= quote, limit-sell at bid <= quote."""
    return (kind.isin("TSL", "TLB") & (bid >= quote)) | ((kind == "TLS") & (bid <= quote))


def ticks(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp, with or without a zone (the session's is UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def from_ticks(t: Column) -> Column:
    return F.timestamp_micros(t)


def clipped_join(limit: int, *parts: Column) -> Column:
    """Parts joined by blanks, cut to a width."""
    return F.substring(F.concat_ws(" ", *parts), 1, limit)


def per_second(count: Column, micros: Column) -> Column:
    """Rate of a count over a time in microseconds (traversed edges per second); null for no time."""
    return F.when(micros > 0, count * 1_000_000.0 / micros)
