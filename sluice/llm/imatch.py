"""I-Match fingerprints.

The lexicon holds the terms whose inverse document frequency lies within a band: not so common that they say nothing, not so rare that
a slip of the pen makes them. Frequencies are those of 64-bit term hashes, counted over all documents. A document's distinct lexicon terms are
sorted and hashed together, once for the whole lexicon and once for each of many randomised subsets of it: CHAINS independent random halvings, in each of which
a quarter of all terms, a sixteenth and so on to 4**-RUNGS is a lexicon of its own, the same for all texts.

A hash over many terms changes with any of them, so a long text that is edited keeps those of the sparse subsets, a short one has terms only in the dense ones.
Two fingerprints are compared at the sparsest rate at which at least half of the subsets have a term of either text: there a
subset agrees about as often as the texts' terms do.

A term of fewer than LEAST documents is outside, whatever the share. The lexicon reaches the texts as a Bloom filter of PROBES bits a term, at least PER_TERM times as many bits as the band has
terms. How many these are doesn't depend on the number of documents (of N distinct terms a document, N / RAREST at most: 2 million for N = 200), so 2**MOST_BITS bits are enough
at any size. Terms outside the band that pass (0.24 % at PER_TERM bits a term) are in the lexicon too, for all texts alike.

The main path is DataFrame functions only.
"""

from __future__ import annotations

import json
import struct
from collections import Counter
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap, cut, hide, shown

CHAINS, RUNGS = 16, 6
#: Bits of the filter: 2**LEAST_BITS to 2**MOST_BITS, PER_TERM for each term of the band, of which PROBES are set.
LEAST_BITS, MOST_BITS, PER_TERM, PROBES = 12, 25, 16, 4
#: Shares of documents: the idf band is log(1 / share). Terms of fewer documents than LEAST are slips of the pen or ids.
RAREST, COMMONEST, LEAST = 1e-4, 0.03, 3
#: Rows that one task orders, for finding the next document: about this many, in at most MOST_RANGES ranges of ids.
RANGE, MOST_RANGES = 2048, 1 << 15
#: Ids drawn for each range, to find where to cut.
DRAWN = 8
_SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text: Column) -> Column:
    """Hashes of the distinct words (runs of letters and digits, A-Z in lower case; anything beyond ASCII is a letter)."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), _SPLIT)
    return F.array_remove(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def slots(term: Column, bits: int) -> list[Column]:
    """PROBES bits of the filter, from two independent hashes of up to 32 bits each."""
    return [w.bitwiseAND(F.lit((1 << bits) - 1)) for h in (term, F.xxhash64(term, F.lit(9))) for w in (h, F.shiftrightunsigned(h, 32))]


def in_band(docs: DataFrame, text: str, rarest: float = RAREST, commonest: float = COMMONEST) -> DataFrame:
    """(term, df): the lexicon, counted over all rows."""
    total = docs.count()
    found = docs.select(F.explode(terms(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return found.where((F.col("df") >= F.lit(max(LEAST, rarest * total))) & (F.col("df") <= F.lit(commonest * total)))


def lexicon(docs: DataFrame, text: str, rarest: float = RAREST, commonest: float = COMMONEST) -> Callable[[Column], Column]:
    """Whether a term is in the lexicon, which the expression carries as a constant. Runs jobs."""
    band = cut(in_band(docs, text, rarest, commonest))
    bits = min(MOST_BITS, max(LEAST_BITS, (PER_TERM * band.count() - 1).bit_length()))
    found = bitmap(band.select(F.explode(F.array(*slots(F.col("term"), bits))).alias("slot")), "slot", max(bits, 15))
    words = F.from_json(F.lit(json.dumps(struct.unpack(f"<{1 << (bits - 6)}q", found[: 1 << (bits - 3)]))), "array<bigint>")
    has = lambda s: F.getbit(F.get(words, F.shiftright(s, 6).cast("int")), s.bitwiseAND(F.lit(63)).cast("int")) == 1
    return lambda term: F.forall(F.array(*slots(term, bits)), has)  # the constant stands in the plan once


def with_fingerprint(rows: DataFrame, text: str, inside: Callable[[Column], Column], into: str) -> DataFrame:
    """`rows` with the fingerprint of `text`: the hash over all terms (64 bits), then rate by rate one for each chain (16 bits), comma-joined ("-": no term in it).

    A term's 64-bit hashes give it 16 random bits in each chain; the subset of rung k are the terms whose first 2 k bits there are 0. Texts without a term in
    the lexicon use all their terms. The steps are columns of their own, so that each is computed once, and a rung's subsets go once they are hashed and halved.
    """
    short = lambda own, digits: F.when(F.size(own) > 0, F.right(F.lower(F.hex(F.xxhash64(own))), F.lit(digits))).otherwise("-")
    steps = rows.withColumn("_all", terms(F.col(text))).withColumn("_in", F.filter("_all", inside))
    steps = steps.withColumn("_own", F.array_sort(F.when(F.size("_in") > 0, F.col("_in")).otherwise(F.col("_all"))))
    steps = steps.withColumn("_bits", F.array(*[F.transform("_own", (lambda w: lambda t: F.xxhash64(t, F.lit(w)))(w)) for w in range(CHAINS // 4)]))
    steps = steps.withColumn("_said", short(F.col("_own"), 16)).drop("_all", "_in", "_own")
    for k in range(1, RUNGS + 1):
        of = [F.get("_bits", F.lit(j // 4)) if k == 1 else F.get("_rung", F.lit(j)) for j in range(CHAINS)]
        mask = [((1 << 2 * k) - 1) << 16 * (j % 4) for j in range(CHAINS)]
        steps = steps.withColumn("_next_rung", F.array(*[F.filter(x, (lambda m: lambda b: b.bitwiseAND(F.lit(m)) == 0)(m)) for x, m in zip(of, mask, strict=True)]))
        steps = steps.drop("_bits", "_rung").withColumnRenamed("_next_rung", "_rung")
        steps = steps.withColumn("_said", F.concat_ws(",", "_said", F.array_join(F.transform("_rung", lambda own: short(own, 4)), ",")))
    return steps.drop("_rung").withColumnRenamed("_said", into)


def likeness(a: Column, b: Column) -> Column:
    """The share of subsets with equal hashes among those in which either text has a term, at the sparsest rate at which these are at least half of all; 1 for equal fingerprints, and 0 where no rate has so many."""
    said = F.zip_with(F.split(a, ","), F.split(b, ","), lambda x, y: F.when((x == "-") & (y == "-"), 0).when(x == y, 2).otherwise(1))
    rungs = []
    for k in range(RUNGS, 0, -1):
        own = F.slice(said, 2 + CHAINS * (k - 1), CHAINS)
        either = F.size(F.filter(own, lambda e: e > 0))
        rungs.append(F.when(either >= CHAINS // 2, F.size(F.filter(own, lambda e: e == 2)) / F.greatest(either, F.lit(1))))
    return F.when(a == b, F.lit(1.0)).otherwise(F.coalesce(*rungs, F.lit(0.0)))


def in_runs(docs: DataFrame, id: str, text: str, range_: int = RANGE) -> DataFrame:
    """(_id, _text, _p, _run): rows in numbered runs of ids, about `range_` rows each, null ids first; _p orders rows of one id.

    The cuts are quantiles of a sample of ids (at most about DRAWN * MOST_RANGES reach the driver). An id that holds several ranges' worth of rows (null is one)
    is spread over as many runs by _p, a hash of the text (a column that depends on the row's values alone, so that Spark
    shuffles the texts once for all readings of the runs).
    """
    rows = docs.select(F.col(id).alias("_id"), F.coalesce(text, F.lit("")).alias("_text"))
    rows = rows.withColumn("_p", F.shiftrightunsigned(F.xxhash64(F.lit(7), "_text"), 1))
    n = docs.count()
    ranges = min(MOST_RANGES, -(-n // range_)) or 1
    uniform = F.col("_p") / F.lit(float(1 << 63))
    place = F.shiftrightunsigned(F.xxhash64(F.lit(7), F.monotonically_increasing_id()), 11) / F.lit(float(1 << 53))
    drawn = docs.select(F.col(id).alias("_id"), place.alias("_u")).where(F.col("_u") < min(1.0, DRAWN * ranges / max(n, 1))).select("_id").collect()
    ids, per = sorted(r[0] for r in drawn if r[0] is not None), max(1, len(drawn) // ranges)
    at = Counter(ids[per - 1 :: per])
    cuts, parts = list(at), [max(1, -(-(len(drawn) - len(ids)) // per)), *[at[c] if at[c] > 1 else 0 for c in at]]
    first = list(accumulate([0, *[p + 1 for p in parts]]))
    const = lambda xs, kind="bigint": F.from_json(F.lit(json.dumps(xs)), f"array<{kind}>")
    steps = [1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)] if cuts else []
    over = lambda k, step: F.when(F.get(const(cuts), k + step - 1) <= F.col("_id"), k + step).otherwise(k)  # noqa: E731  binary search
    rows = rows.withColumn("_k", F.when(F.col("_id").isNull(), 0).otherwise(F.aggregate(const(steps, "int"), F.lit(0), over)))
    share = F.get(const(parts), F.col("_k"))
    same = F.col("_id").isNull() | (F.get(const(cuts), F.col("_k") - 1) == F.col("_id"))
    sub = F.when(same & (share > 0), F.floor(uniform * share)).otherwise(share)
    # never null, which Spark can tell: no join adds a filter below the shuffle, and all readings of the runs share one
    return rows.withColumn("_run", F.coalesce(F.get(const(first), F.col("_k")) + sub, F.lit(0).cast("bigint"))).drop("_k")


def with_next(rows: DataFrame, value: str, into: str) -> DataFrame:
    """`rows` (_id, _p, _run and a `value` that is never null) with the value of the row that follows by id (after the last: the first).

    Rows that repeat an id follow each other by _p. Each run is ordered apart; the last row of a run
    gets the first value of the next, by a join of one row per run. The three readings of the ordered runs share one shuffle.
    """
    order = Window.partitionBy("_run").orderBy(F.col("_id").asc_nulls_first(), "_p")
    placed = rows.withColumn(into, F.lead(value).over(order)).withColumn("_before", F.lag("_p").over(order))
    along = Window.orderBy("_run")
    runs = rows.select("_run").distinct().select("_run", F.coalesce(F.lag("_run").over(along), F.max("_run").over(Window.partitionBy())).alias("_to"))
    heads = placed.where("_before IS NULL").select("_run", F.col(value).alias("_head")).join(cut(runs), "_run").select(F.col("_to").alias("_run"), "_head")
    inner = placed.where(F.col(into).isNotNull()).select(*rows.columns, into)
    last = placed.where(F.col(into).isNull()).select(*rows.columns).join(heads, "_run")
    return inner.unionByName(last.select(*rows.columns, F.col("_head").alias(into)))


def fingerprints(docs: DataFrame, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """`docs` with the fingerprint of each text; equal texts have equal ones. Null and empty texts, and texts without words, have no term in any chain."""
    docs, names = hide(docs)
    out = with_fingerprint(docs, names[text], lexicon(docs, names[text]), "_fingerprint")
    return out.select(*shown(names, into), F.col("_fingerprint").alias(into))


def compare(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The edited text has its last quarter of code points replaced by as many from the start of the next document (or all it has). Null is
    empty, null ids come first, and rows that repeat an id follow each other by a hash of their text. Other columns are not read. A single row is its own next document.
    """
    lex = lexicon(docs, text)
    rows = with_next(in_runs(docs, id, text), "_text", "_next")
    n = F.length("_text")
    q = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), n - q), F.substring(F.col("_next"), F.lit(1), q))
    rows = rows.select("_run", "_id", "_p", n.cast("long").alias("n_chars"), "_text", F.coalesce(edited, F.lit("")).alias("_edited"))
    rows = with_fingerprint(with_fingerprint(rows, "_text", lex, "fingerprint"), "_edited", lex, "edited_fingerprint")
    rows = cut(rows.select("_run", "_id", "_p", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint"))
    rows = with_next(rows, "fingerprint", "_fn")
    near = [likeness(F.col("fingerprint"), F.col(c)).alias(into) for c, into in (("edited_fingerprint", "near_edited"), ("_fn", "near_next"))]
    return rows.select(F.col("_id").alias(id), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *near)
