"""N-gram Jaccard join by parity sketches.

Documents are sets of hashed word 5-grams. Two link when their Jaccard similarity is at least 0.8, so for sizes
a <= b their symmetric difference D is at most (a + b) / 9 <= a / 4, and b <= 1.25 a.

Sketch. The n-grams are dealt to m groups by hash; each group keeps the XOR (the parity, bit by bit) of its n-grams'
hashes. D differing n-grams touch at most D groups, so two similar sets agree in at least m - D groups: the pigeonhole
principle. Sets are sketched per size band (one family of groups for pairs within a band, one for pairs across two neighbouring bands),
so m follows the size.

Prefix. As similar sets agree in at least m - a/4 of m groups, it is enough that each emits the first
a/4 + 1 + h of its groups in an order all sets share; similar pairs then share at least 1 + h emitted groups. The
order puts groups with many n-grams first: those are rare, while empty or single ones may be common to many sets.
If at most h of a set's groups are hot (shared by more than HOT sets), it doesn't need them: one of 1 + h shared
groups is not hot. Hot groups are kept only for sets with more than h of them ("heavy": members of large
families of near copies). So a passage that many documents share makes no large buckets, and nothing is lost.

Candidates. Exactly equal sets are one class with one representative. In a bucket (representatives with an equal group),
each is paired with the first and with the one before it. Pairs pass if a second, whole-set bit sketch allows it: its Hamming distance is a
lower bound of D. What passes is verified on the full sets. Then, for buckets that still hold several components, the pairs
across components are tried too, which makes the result exact: no link between different texts is lost. Hot buckets are cut
into blocks for that, and sketches are compared block against block: no row per pair is made.

Hot keys. Exact copies and members of large families of near copies share their keys. A class is gathered in CELLS cells first, then the cells are; so are the groups that a
sample of documents shows to be shared by many. Large buckets are ordered cell by cell, and documents get the names of their
classes and components by `lookup`, which broadcasts the largest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bitmap, cut, hide, lookup, shown, whole_texts
from .hashing import Spelled as Words
from .hashing import lower_words, mix, rolling  # noqa: F401  (what `Words.of` gives the ids of)

K = 5
#: Upper ends of the size bands (sizes below the first are the first band).
BANDS = np.array([8 * 4**i for i in range(13)], np.int64)
#: A group shared by more representatives than this is hot.
HOT = 32
#: Members of a hot bucket that are compared at once with as many others.
BLOCK = 2048
BITS = 24
#: Edges that one task takes when components are found: small graphs make few files.
EDGES = 200_000
#: Cells among which the rows of one class or hot group are dealt.
CELLS = 64
#: Documents looked at, about, to find groups that more than 1/OFTEN of all share.
SAMPLE, OFTEN = 4096, 512
#: Characters of texts whose words are hashed at once.
TOGETHER = 1 << 16
_ROWS = "sig long, _row long, cell byte, n int, sketch binary"
_CLASS = 31


def groups_of(family: int) -> tuple[int, int]:
    """(m, h) of a family: 2 * band for pairs within it, 2 * band + 1 for pairs across it and the next."""
    top = int(BANDS[family // 2]) * (1.25 if family % 2 else 1.0)
    return int(np.ceil(0.32 * top)) + 4, int(np.ceil(0.03 * top)) + 1


def families(n: int) -> list[int]:
    band = int(np.searchsorted(BANDS, n, side="right"))
    out = [2 * band]
    if band and 4 * n <= 5 * (int(BANDS[band - 1]) - 1):
        out.append(2 * band - 1)
    if 5 * n >= 4 * int(BANDS[band]):
        out.append(2 * band + 1)
    return out


def _starts(x: np.ndarray) -> np.ndarray:
    """Where a run of equal numbers starts."""
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return np.flatnonzero(new)


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, each once: quicker than `np.unique` on a few hundred numbers."""
    x = np.sort(x)
    return x[_starts(x)]


def shingles(words: Words, text: str | None, k: int = K) -> np.ndarray:
    """The set of hashed k-grams, sorted (fewer words: the whole sequence; none: empty)."""
    return many_shingles(words, [text], k)[0]


def many_shingles(words: Words, texts: list[str | None], k: int = K) -> list[np.ndarray]:
    """`shingles` of each text, hashed together."""
    ids = words.of(texts)
    end = np.cumsum([len(x) for x in ids])
    grams = rolling(np.concatenate(ids), k) if len(end) and end[-1] >= k else np.zeros(0, np.uint64)
    return [_distinct(grams[e - len(x) : e - k + 1] if len(x) >= k else rolling(x, k)) for x, e in zip(ids, end.tolist(), strict=True)]


def signatures(s: np.ndarray, family: int) -> np.ndarray:
    """The parity groups that the set `s` emits in `family`; the low 5 bits name the family."""
    m, h = groups_of(family)
    x = mix(s + np.uint64(family * 0x1F123BB5 + 1))
    group = ((x >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(group.astype(np.uint16) if m <= 1 << 16 else group, kind="stable")  # 16 bits are sorted by radix
    group, x = group[order], x[order]
    start = _starts(group)
    count = np.empty(len(start), np.int64)
    count[:-1], count[-1] = start[1:] - start[:-1], len(x) - start[-1]
    parity, at = np.bitwise_xor.reduceat(x, start), group[start]
    want = min(m, len(s) // 4 + 1 + h)
    if len(at) < want:  # empty groups count as well
        there = np.zeros(m, bool)
        there[at] = True
        empty = np.flatnonzero(~there)
        parity, count, at = np.r_[parity, np.zeros(len(empty), np.uint64)], np.r_[count, np.zeros(len(empty), np.int64)], np.r_[at, empty]
    sig = mix(mix(parity + at.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)) + count.astype(np.uint64) + np.uint64(family << 40))
    first = np.lexsort((sig, -count))[:want]
    return (sig[first] & ~np.uint64(31)) | np.uint64(family)


def bits_of(n: int) -> int:
    return 1 << max(9, int(2 * n - 1).bit_length()) if n else 512


def sketch(s: np.ndarray) -> bytes:
    """Parity of the n-grams per bit, over a power of two of about 2 to 4 bits per n-gram."""
    size = bits_of(len(s))
    odd = np.bincount((mix(s) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def distance(a: bytes, b: bytes) -> int:
    """Hamming distance; the longer sketch is folded to the shorter, which keeps parities."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    if len(y) > len(x):
        y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def _sets(words: Words, texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The shingles of each text; texts of about TOGETHER characters are hashed at once."""
    some, size = [], 0
    for text in texts:
        some.append(text.as_py())
        size += len(some[-1] or "")
        if size >= TOGETHER:
            yield from many_shingles(words, some, k)
            some, size = [], 0
    yield from many_shingles(words, some, k)


def _emit(docs: DataFrame, k: int, often: np.ndarray) -> DataFrame:
    """Per document one class row (n and sketch set), and the signatures of the first document of each class that a task meets.

    Class rows and signatures that are in `often` (sorted) have a cell by their row; for others it is -1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = Words(), set()
        for batch in batches:
            sigs, rows, counts, ns, sks = [], [], [], [], []

            def flush() -> pa.RecordBatch:
                sig = np.concatenate(sigs).view(np.int64)
                row = np.repeat(np.array(rows, np.int64), counts)
                n, sk = pa.array(ns, pa.int32()), pa.array(sks, pa.binary())
                head = np.cumsum([0, *counts[:-1]])
                apart = np.isin(sig, often)
                apart[head] = True
                cell = np.where(apart, (mix(row.view(np.uint64)) % np.uint64(CELLS)).astype(np.int8), np.int8(-1))
                take = np.full(len(sig), -1, np.int64)
                take[head] = np.arange(len(head))
                at = pa.array(take, mask=take < 0)
                return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(row), pa.array(cell), n.take(at), sk.take(at)], ["sig", "_row", "cell", "n", "sketch"])

            held = 0
            for row, s in zip(batch.column(0).to_pylist(), _sets(words, batch.column(1), k), strict=True):
                n = len(s)
                own = mix(np.array([row], np.uint64)) if n == 0 else mix(np.add.reduce(mix(s), keepdims=True) ^ mix(np.bitwise_xor.reduce(s, keepdims=True) + np.uint64(n)))
                own = (own & ~np.uint64(31)) | np.uint64(_CLASS)
                parts = [own]
                if n and (key := int(own[0])) not in seen:
                    seen.add(key)
                    parts += [signatures(s, f) for f in families(n)]
                sig = np.concatenate(parts)
                sigs.append(sig), rows.append(row), counts.append(len(sig)), ns.append(n), sks.append(sketch(s))
                held += len(sig)
                if held > 400_000:
                    yield flush()
                    sigs, rows, counts, ns, sks, held = [], [], [], [], [], 0
            if sigs:
                yield flush()

    return docs.select("_row", "_text").mapInArrow(run, _ROWS)


def _often(docs: DataFrame, k: int) -> np.ndarray:
    """Signatures that more than about 1/OFTEN of all documents share, by a sample of about SAMPLE of them; at most OFTEN times a document's signatures. What it misses costs time only."""
    total = docs.count()
    if total <= BLOCK:
        return np.zeros(0, np.int64)
    few = docs.where(F.shiftrightunsigned(F.xxhash64(F.lit(13), "_row"), 11) / F.lit(float(1 << 53)) < min(1.0, SAMPLE / total))
    sigs = _emit(few, k, np.zeros(0, np.int64)).where("n IS NULL").groupBy("sig").agg(F.count("*").alias("c"))
    least = max(BLOCK / total, 1.0 / OFTEN) * min(total, SAMPLE)
    return np.sort(np.array([r[0] for r in sigs.where(F.col("c") >= least).select("sig").collect()], np.int64))


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _bucket_pairs(members: DataFrame) -> DataFrame:
    """Each member of a bucket (sig, rep, c) with the bucket's first and with the one before it. Buckets of more than BLOCK are cut into cells, whose firsts are paired with the bucket's.

    A cell is what comes from one partition of the input: so neighbours are the same in all buckets that two members share.
    """
    members = members.withColumn("_cell", F.when(F.col("c") > BLOCK, F.shiftright("rep", 33)).otherwise(0).cast("int"))
    up = Window.partitionBy("sig", "_cell").orderBy("rep")
    near = members.select("rep", F.lag("rep").over(up).alias("prev"), F.first("rep").over(up).alias("first")).where("prev IS NOT NULL")
    pairs = near.select("rep", F.explode(F.array_distinct(F.array("prev", "first"))).alias("other"))
    heads = members.where(F.col("c") > BLOCK).groupBy("sig", "_cell").agg(F.min("rep").alias("rep"))
    firsts = heads.groupBy("sig").agg(F.min("rep").alias("other"))
    pairs = pairs.union(heads.join(firsts, "sig").where("rep <> other").select("rep", "other"))
    return pairs.select(*_ordered("rep", "other")).distinct()


def _allowed(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose sizes and bit sketches don't rule out a similarity of 0.8."""
    @F.pandas_udf(T.BooleanType())
    def near(na: pd.Series, nb: pd.Series, sa: pd.Series, sb: pd.Series) -> pd.Series:
        return pd.Series([9 * distance(x, y) <= p + q for p, q, x, y in zip(na, nb, sa, sb, strict=True)], dtype=bool)

    side = lambda s: classes.select(F.col("_row").alias(s), F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"s{s}"))
    both = pairs.join(side("a").drop("sa"), "a").join(side("b"), "b").where(5 * F.least("na", "nb") >= 4 * F.greatest("na", "nb"))
    return both.join(side("a").drop("na"), "a").where(near("na", "nb", "sa", "sb")).select("a", "b", "na", "nb")


def _fold(x: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_xor.reduce(x.reshape(len(x), -1, words), axis=1)


def near_pairs(rep: np.ndarray, comp: np.ndarray, n: np.ndarray, sketches: list[bytes], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a `left` and a `right` member, of different components, that sizes and sketches allow."""
    length = np.array([len(x) // 8 for x in sketches])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    sides = [{w: np.flatnonzero(side & (length == w)) for w in np.unique(length[side])} for side in (left, right)]
    for w, i in sides[0].items():
        for v, j in sides[1].items():
            k = int(min(w, v))
            x, y = (_fold(np.frombuffer(b"".join(sketches[t] for t in at), np.uint64).reshape(len(at), -1), k) for at in (i, j))
            for at in range(0, len(i), 64):  # bounds the matrices
                some, rows = i[at : at + 64], x[at : at + 64]
                small, large = np.minimum(n[some][:, None], n[j]), np.maximum(n[some][:, None], n[j])
                p, q = np.nonzero((comp[some][:, None] != comp[j]) & (5 * small >= 4 * large))
                ok = 9 * np.bitwise_count(rows[p] ^ y[q]).sum(1, dtype=np.int64) <= n[some][p] + n[j][q]
                found.append((rep[some[p[ok]]], rep[j[q[ok]]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _block_pairs(members: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) across components within hot buckets (sig, rep, comp, c) that sizes and sketches allow.

    A member meets every block of its bucket once. A pair comes from the first of the buckets it shares: members carry the list of theirs.
    """
    lists = members.groupBy("rep").agg(F.array_sort(F.collect_list("sig")).alias("sigs"))
    whole = members.join(lists, "rep").join(reps.select(F.col("_row").alias("rep"), "n", "sketch"), "rep")
    whole = whole.withColumn("_k", F.ceil(F.col("c") / BLOCK).cast("int")).withColumn("_b", F.pmod(F.xxhash64("rep"), F.col("_k")).cast("int"))
    whole = whole.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    whole = whole.withColumn("_i", F.least("_b", "_o")).withColumn("_j", F.greatest("_b", "_o"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        i, j, b = int(group["_i"].iat[0]), int(group["_j"].iat[0]), group["_b"].to_numpy()
        rep, sig = group["rep"].to_numpy(), int(group["sig"].iat[0])
        x, y = near_pairs(rep, group["comp"].to_numpy(), group["n"].to_numpy(np.int64), list(group["sketch"]), b == i, b == j)
        sigs = dict(zip(rep.tolist(), group["sigs"], strict=True))
        here = [np.intersect1d(sigs[p], sigs[q], assume_unique=True)[0] == sig for p, q in zip(x.tolist(), y.tolist(), strict=True)]
        return pd.DataFrame({"a": np.minimum(x, y)[here], "b": np.maximum(x, y)[here]}).drop_duplicates()

    return whole.groupBy("sig", "_i", "_j").applyInPandas(compare, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The pairs that link, by the intersection of their full sets."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("_row")).distinct()
    # a row number has its partition in the high bits
    spread = F.shiftright("_row", 33) * 1000003 + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    flags = np.frombuffer(bitmap(asked.select(spread.alias("h")), "h", BITS), np.uint8)
    mask = (1 << BITS) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            rows = batch.column(0).to_numpy()
            at = ((rows >> 33) * 1000003 + (rows & ((1 << 33) - 1))) & mask
            pick = np.flatnonzero((flags[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            for some in np.array_split(pick, max(1, len(pick) // 500)):
                sets = [s.tobytes() for s in _sets(words, batch.column(1).take(pa.array(some)), k)]
                yield pa.RecordBatch.from_arrays([pa.array(rows[some]), pa.array(sets, pa.binary())], ["_row", "grams"])

    @F.pandas_udf(T.BooleanType())
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y, strict=True):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            both = len(p) + len(q) - len(np.union1d(p, q))
            out.append(100 * both >= 80 * (len(p) + len(q) - both))
        return pd.Series(out, dtype=bool)

    sets = docs.select("_row", "_text").mapInArrow(run, "_row long, grams binary")
    left = pairs.select("a", "b").join(sets.select(F.col("_row").alias("a"), F.col("grams").alias("ga")), "a")
    return left.join(sets.select(F.col("_row").alias("b"), F.col("grams").alias("gb")), "b").where(linked("ga", "gb")).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for all nodes of `edges` (a, b): the smallest node reachable.

    Each round hooks every root to the smallest root beside it, follows the hooks to their ends, and contracts the edges to what still joins two roots.
    A root that has no smaller one beside it takes in a neighbour, or sees a smaller root in the next round; so two rounds at least
    halve the roots of each unfinished component, whatever its diameter and the order of its rows.
    """
    parts = -(-edges.count() // EDGES) or 1  # what follows only shrinks

    def done(df: DataFrame) -> DataFrame:
        """Checkpointed in as many partitions as the edges need, as new rows: else the optimiser's estimate of the size is squared by every join, to numbers of millions of digits."""
        spark, rows = df.sparkSession, cut(df.coalesce(parts))._jdf
        return type(df)(spark._jsparkSession.createDataFrame(rows.toJavaRDD(), rows.schema()), spark)

    both = done(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    label = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("comp"))
    while not both.isEmpty():
        hook = done(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("root"), F.least("a", "m").alias("up")))
        while True:  # each pass doubles the length of the hooks followed
            over = hook.select(F.col("root").alias("up"), F.col("up").alias("over"))
            new = done(hook.join(over, "up").select("root", F.col("over").alias("up"), F.col("up").alias("was")))
            hook = new.drop("was")
            if new.where("up <> was").isEmpty():
                break
        label = done(label.join(hook.withColumnRenamed("root", "comp"), "comp", "left").select("node", F.coalesce("up", "comp").alias("comp")))
        x, y = (hook.select(F.col("root").alias(c), F.col("up").alias(f"{c}_up")) for c in "ab")
        both = done(both.join(x, "a").join(y, "b").where("a_up <> b_up").select(F.col("a_up").alias("a"), F.col("b_up").alias("b")).distinct())
    return label


def join(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = K, hot: int = HOT) -> DataFrame:
    """One row per row of `docs`: id, `n_shingles`, `component_id` (smallest id reachable by links, its own included), `keep` (true for one row of each component) and `_row`.

    Null, empty and blank texts have no shingles and link with nothing. Rows that repeat an id are documents of
    their own. A null id counts as larger than any other and is a component's id only if all are null. `docs` must be the same when it is read again, as a scan
    of files is. Columns other than id and text are not read.
    """
    whole_texts(docs.sparkSession)
    docs = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    by_cell = Window.partitionBy("sig", "cell")
    rows = _emit(docs, k, _often(docs, k)).withColumn("c", F.count("*").over(by_cell)).withColumn("near", F.when(F.col("n").isNotNull(), F.min("_row").over(by_cell)))
    rows = cut(rows.where("c > 1 OR cell >= 0"))
    every = rows.where("n IS NOT NULL")
    heads = every.where("_row = near").select("sig", "near", "c")
    heads = heads.withColumn("rep", F.min("near").over(Window.partitionBy("sig"))).select("near", "rep", "c")  # CELLS rows a class at most
    every = cut(lookup(every.select("_row", "n", "sketch", "near"), heads, "near", "c", F.col("_row")).drop("near"))
    reps = every.where("_row = rep").select("_row", "n", "sketch")

    # a signature is never null; where Spark can tell, joins add no filter, and the readings of `members` share their shuffles
    sigs = rows.where("n IS NULL").select(F.coalesce("sig", F.lit(0).cast("long")).alias("sig"), "_row")
    members = sigs.join(every.select("_row", "rep"), "_row").select("sig", "rep").distinct()
    shared = members.groupBy("sig").agg(F.count("*").alias("w")).where("w > 1").withColumn("c", F.col("w"))
    members = cut(lookup(members, shared, "sig", "w", F.col("rep")).where("c IS NOT NULL"))
    family = F.col("sig").bitwiseAND(F.lit(31))
    spare = F.element_at(F.array(*[F.lit(groups_of(f)[1]) for f in range(2 * len(BANDS))]), (family + 1).cast("int"))
    heavy = members.where(F.col("c") > hot).groupBy("rep", family.alias("f")).agg(F.count("*").alias("hots"), F.first(spare).alias("spare")).where("hots > spare").select("rep", "f")
    crowd = members.where(F.col("c") > hot).withColumn("f", family).join(heavy, ["rep", "f"], "left_semi").select("sig", "rep", "c")
    members = cut(members.where(F.col("c") <= hot).select("sig", "rep", "c").union(crowd))

    first = cut(_allowed(_bucket_pairs(members), reps))
    links = cut(_verified(first, docs, k))
    found = components(links)

    named = members.join(found.select(F.col("node").alias("rep"), "comp"), "rep", "left").select("sig", "rep", F.coalesce("comp", "rep").alias("comp"))
    open_ = named.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c")).where("lo <> hi AND c > 2").select("sig", "c", F.col("c").alias("w"))
    left = cut(lookup(named, open_, "sig", "w", F.col("rep")).where("c IS NOT NULL"))
    x, y = (left.where(F.col("c") <= hot).join(reps.select(F.col("_row").alias("rep"), "n"), "rep").select("sig", *[F.col(c).alias(f"{s}{c}") for c in ("rep", "comp", "n")]) for s in "xy")
    few = x.join(y, "sig").where("xrep < yrep AND xcomp <> ycomp AND 5 * least(xn, yn) >= 4 * greatest(xn, yn)").select(*_ordered("xrep", "yrep")).distinct()
    many = _block_pairs(left.where(F.col("c") > hot), reps).distinct()
    untried = few.join(first.select("a", "b"), ["a", "b"], "left_anti")
    more = cut(_allowed(untried, reps).select("a", "b").union(many.join(first.select("a", "b"), ["a", "b"], "left_anti")).distinct())
    if not more.isEmpty():
        extra = cut(_verified(more, docs, k))
        if not extra.isEmpty():
            found = components(links.union(extra))

    sizes = every.groupBy("rep").agg(F.count("*").alias("w")).join(found.select(F.col("node").alias("rep"), "comp"), "rep")
    comp = lookup(every.select("_row", "n", "rep"), sizes, "rep", "w", F.col("_row")).select("_row", "n", F.coalesce("comp", "rep").alias("comp"))
    comp = cut(docs.select("_row", "_id").join(comp, "_row"))
    least = comp.groupBy("comp").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_row")).alias("least"), F.count("*").alias("w"))
    out = lookup(comp, least, "comp", "w", F.col("_row"))
    return out.select(F.col("_id").alias(id), F.col("n").cast("long").alias("n_shingles"), F.col("least._id").alias("component_id"), (F.col("least._row") == F.col("_row")).alias("keep"), "_row")


def deduplicate(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """`docs` without the rows that link, directly or through others, to a row with a smaller id (of repeated rows one stays)."""
    drop = join(docs, id, text, k).where("NOT keep").select(F.col("_row").alias("_drop"))
    docs, names = hide(docs)
    kept = docs.withColumn("_row", F.monotonically_increasing_id()).join(drop, F.col("_row") == F.col("_drop"), "left_anti")
    return kept.select(*shown(names))
