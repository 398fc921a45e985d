"""RAID address maps and parity as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def address(level: int, logical: Column, chunk: int, members: int, layout: str = "left-symmetric", copies: int = 2) -> dict[str, Column]:
    """member, member_offset, stripe (and parity members) of a logical byte."""
    k, within = F.floor(logical / chunk), logical % chunk
    if level == 0:
        stripe = F.floor(k / members)
        return {"member": k % members, "member_offset": stripe * chunk + within, "stripe": stripe}
    if level == 1:
        return {"member": F.lit(0), "member_offset": logical, "stripe": k}
    if level == 10:
        slot = k * copies
        stripe = F.floor(slot / members)
        return {"member": slot % members, "member_offset": stripe * chunk + within, "stripe": stripe}
    data = members - (2 if level == 6 else 1)
    stripe, d = F.floor(k / data), k % data
    left, symmetric = layout.startswith("left"), layout.endswith("-symmetric")
    parity = (members - 1 - stripe % members) if left else stripe % members
    if level == 5:
        member = (parity + 1 + d) % members if symmetric else d + F.when(d >= parity, 1).otherwise(0)
        return {"member": member, "member_offset": stripe * chunk + within, "stripe": stripe, "parity": parity}
    q = (parity + 1) % members
    member = (q + 1 + d) % members if symmetric else F.when(parity == members - 1, d + 1).otherwise(d + F.when(d >= parity, 2).otherwise(0))
    return {"member": member, "member_offset": stripe * chunk + within, "stripe": stripe, "parity": parity, "q": q}


def rebuild(words: DataFrame, stripe: str, at: str, word: str, lost: Column) -> DataFrame:
    """XOR of all other members' words gives the lost member's (8-byte words as longs)."""
    return words.where(~lost).groupBy(stripe, at).agg(F.bit_xor(word).alias("rebuilt"))
