"""IP prefixes as columns: struct<family INT, hi BIGINT, lo BIGINT, plen INT>.

IPv4 addresses are the low 32 bits of `lo` (hi is 0), IPv6 addresses fill both words. Words are compared for
equality only; where order matters, see `sort_key`. All expressions are built in, textual IPv6 included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = {4: 32, 6: 128}


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hex_word(groups: Column, first: int) -> Column:
    """Four 16-bit groups from index `first` (0-based) as one signed 64-bit word."""
    return F.aggregate(F.slice(groups, first + 1, 4), F.lit(0).cast("long"), lambda acc, g: F.call_function("shiftleft", acc, F.lit(16)).bitwiseOR(F.conv(g, 16, 10).cast("long")))


def _v6_groups(address: Column) -> Column:
    """The eight groups of a textual IPv6 address, "::" filled up; null if there are not eight."""
    listed = lambda s: F.filter(F.split(s, ":"), lambda g: g != "")
    filled = lambda p: F.concat(p["l"], F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(p["l"]) - F.size(p["r"]))), p["r"])
    ends = lambda h: F.struct(listed(F.get(h, F.lit(0))).alias("l"), listed(F.coalesce(F.get(h, F.lit(1)), F.lit(""))).alias("r"))
    whole = _let(F.split(address, "::"), lambda h: F.when(F.size(h) == 2, _let(ends(h), filled)).when(F.size(h) == 1, F.split(address, ":")))
    return _let(whole, lambda g: F.when((F.size(g) == 8) & F.forall(g, lambda x: x.rlike("^[0-9A-Fa-f]{1,4}$")), g))


def mask_word(word: Column, keep: Column) -> Column:
    """The highest `keep` bits of a 64-bit word (0 or fewer: none; 64 or more: all). Shifts count modulo 64, hence the guards."""
    cut = (F.lit(64) - keep).cast("int")
    return F.when(keep <= 0, F.lit(0).cast("long")).when(keep >= 64, word).otherwise(F.call_function("shiftleft", F.call_function("shiftrightunsigned", word, cut), cut))


def masked(family: Column, hi: Column, lo: Column, plen: Column) -> tuple[Column, Column]:
    """(hi, lo) with all bits past `plen` cleared."""
    v4 = mask_word(lo, plen + 32)
    return F.when(family == 4, F.lit(0).cast("long")).otherwise(mask_word(hi, plen)), F.when(family == 4, v4).otherwise(mask_word(lo, plen - 64))


def parse_prefix(text: Column) -> Column:
    """A textual prefix or address to its struct, host bits cleared; malformed text gives null."""
    word = lambda family, hi, lo: F.struct(F.lit(family).alias("family"), hi.alias("hi"), lo.alias("lo"))
    quads = lambda a: F.aggregate(F.split(a, r"\."), F.lit(0).cast("long"), lambda acc, q: F.when(q.try_cast("int") <= 255, acc * 256 + q.cast("long")))
    v4 = lambda a: _let(quads(a), lambda x: F.when(x.isNotNull(), word(4, F.lit(0).cast("long"), x)))
    v6 = lambda a: _let(_v6_groups(a), lambda g: F.when(g.isNotNull(), word(6, _hex_word(g, 0), _hex_word(g, 4))))
    address = lambda a: F.when(a.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), v4(a)).when(a.contains(":"), v6(a))

    def prefix(p: Column) -> Column:
        width = F.when(p["a"]["family"] == 4, 32).otherwise(128)
        plen = F.coalesce(p["n"], width)
        hi, lo = masked(p["a"]["family"], p["a"]["hi"], p["a"]["lo"], plen)
        return F.when(p["a"].isNotNull() & p["ok"] & (plen <= width), F.struct(p["a"]["family"].alias("family"), hi.alias("hi"), lo.alias("lo"), plen.alias("plen")))

    def parts(x: Column) -> Column:
        n = F.get(x, F.lit(1))
        return F.struct(_let(F.get(x, F.lit(0)), address).alias("a"), n.try_cast("int").alias("n"), (n.isNull() | n.rlike(r"^\d{1,3}$")).alias("ok"))

    return _let(F.split(text, "/"), lambda x: F.when(F.size(x) <= 2, _let(parts(x), prefix)))


def v4_text(address: Column, plen: Column) -> Column:
    """An IPv4 address (BIGINT) and length as "a.b.c.d/n"."""
    octet = lambda s: F.shiftright(address, s).bitwiseAND(F.lit(255)).cast("string")
    return F.concat(F.concat_ws(".", octet(24), octet(16), octet(8), octet(0)), F.lit("/"), plen.cast("string"))


def family_of(text: Column) -> Column:
    return F.when(text.contains(":"), 6).otherwise(4)


def sort_key(p: Column) -> Column:
    """16 bytes that compare like the address: both words in hexadecimal, unsigned."""
    word = lambda w: F.lpad(F.hex(w), 16, "0")
    return F.unhex(F.concat(word(p["hi"]), word(p["lo"])))


def size_of(family: Column, plen: Column) -> Column:
    """Addresses in a prefix, as a double: an exact power of two for either family."""
    return F.pow(F.lit(2.0), (F.when(family == 4, 32).otherwise(128) - plen).cast("double"))


def cidr_cover(start: Column, count: Column) -> Column:
    """The minimal IPv4 prefixes that cover [start, start + count): array<struct<addr BIGINT, plen INT>>, by address.

    A block of size 2**k at an address of its own size is in the cover exactly if it lies inside the range and its
    parent does not. Per k only the first and the last aligned block of the range can qualify.
    """
    end = start + count
    power = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)

    def picks(k: Column) -> Column:
        step = power(k)
        first, last = start + step - 1 - (start + step - 1) % step, end - end % step - step

        def pick(at: Column) -> Column:
            parent = at - at % (2 * step)
            inside = (at >= start) & (at + step <= end)
            parent_in = (parent >= start) & (parent + 2 * step <= end) & (k < 32)
            return F.when(inside & ~parent_in, F.struct(at.cast("long").alias("addr"), (32 - k).alias("plen")))

        return F.array(pick(first), F.when(last != first, pick(last)))

    levels = F.sequence(F.lit(0), F.least(F.lit(32), F.floor(F.log2(count.cast("double"))).cast("int")))
    none = F.array().cast("array<struct<addr:bigint,plen:int>>")
    return F.when(count >= 1, F.array_sort(F.array_compact(F.flatten(F.transform(levels, picks))))).otherwise(none)


def cover_rows(df: DataFrame, start: str, count: str) -> DataFrame:
    """A row for each of the minimal IPv4 prefixes that cover [start, start + count): `df` with addr BIGINT and plen INT. A row whose count is 0, less or null has none.

    As `cidr_cover`, but the two candidates of each k are rows that plain columns decide on: nothing is sorted or gathered.
    """
    s, end, k, at = F.col(start), F.col(start) + F.col(count), F.col("_k"), F.col("addr")
    one = F.lit(1).cast("long")
    aligned = lambda x, bits: F.call_function("shiftleft", F.call_function("shiftright", x, bits), bits)
    levels = df.where(F.col(count) >= 1).withColumn("_k", F.explode(F.sequence(F.lit(0), F.least(F.lit(32), F.floor(F.log2(F.col(count).cast("double"))).cast("int")))))
    levels = levels.withColumn("_size", F.call_function("shiftleft", one, k))
    first, last = aligned(s + F.col("_size") - 1, k), aligned(end, k) - F.col("_size")
    both = levels.withColumn("_first", first).withColumn("_last", last).withColumn("_turn", F.explode(F.array(F.lit(0), F.lit(1))))
    found = both.withColumn("addr", F.when(F.col("_turn") == 0, F.col("_first")).otherwise(F.col("_last"))).where("_turn = 0 OR _last <> _first")
    parent = aligned(at, k + 1)
    inside = (at >= s) & (at + F.col("_size") <= end)
    parent_in = (parent >= s) & (parent + 2 * F.col("_size") <= end) & (k < 32)
    return found.where(inside & ~parent_in).withColumn("plen", 32 - k).drop("_k", "_size", "_first", "_last", "_turn")
