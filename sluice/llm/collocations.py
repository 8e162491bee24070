"""Phrases whose words stand together more often than their parts explain, mined from vertical positional lists.

A block of texts of one language is held as postings: for every word the ascending list of its positions, where a break between pieces takes a
position of its own. Level by level, the occurrences of frequent phrases are extended: the position after each occurrence is merge-joined with
the postings of frequent words, and the occurrences found, grouped by phrase, are the lists of the next level. The length of a list is the phrase's exact
frequency in the block; Spark adds the lengths up over blocks, so what is shuffled is one number for each phrase of a block, and positions never leave their
task. As in Apriori, a phrase can only be frequent if the phrases that it begins and ends with are, so between levels the blocks learn which are: as a bitmap of fixed
size, which lets all frequent ones pass. Those that pass by chance fail the threshold afterwards, so the counts are exact at any size of data.

Words are 64-bit numbers in these lists, made from language and word; they are checked to be different for different words, else another seed is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap, cut, whole_texts
from .hashing import mix

LEAST, LONGEST, TOP, COVER = 10, 3, 2000, 50
UNKNOWN = "und"
BREAKS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Bytes of a block of texts, and of a stretch of it that is split at once.
BLOCK, STRETCH = 12 << 20, 1 << 20
#: Words of more bytes are hashed one by one.
PLAIN = 64
#: Bits of the bitmaps of frequent words and of frequent phrases.
WORD_BITS, PHRASE_BITS = 24, 26
#: The candidates of a language are ranked in so many parts first.
PARTS = 256

LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))
KINDS = np.zeros(256, np.uint8)
KINDS[list(GAPS)], KINDS[list(BREAKS)] = 1, 2


def _number(*parts: bytes) -> int:
    return int.from_bytes(blake2b(b"\0".join(parts), digest_size=8).digest(), "little")


class Scanner:
    """Words of a block: their ids, positions and places in the bytes."""

    def __init__(self, seed: int) -> None:
        self.seed = str(seed).encode()
        self.of_byte = np.array([_number(self.seed, bytes([b])) for b in range(256)], np.uint64)
        self.base = _number(self.seed, b"base") | 5  # odd, so it has an inverse
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if n > len(self.up):
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, self.base, np.uint64)]), dtype=np.uint64)
            back = np.uint64(pow(self.base, -1, 1 << 64))
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, back, np.uint64)]), dtype=np.uint64)

    def __call__(self, lang: str, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids, positions (one apart within a piece, more between pieces), starts and ends in `data`, which is in lower case."""
        found, at = [], 0
        while at < len(data):
            end = min(at + STRETCH, len(data))
            if end < len(data):
                cuts = np.flatnonzero(KINDS[np.frombuffer(data, np.uint8, end - at, at)])
                if len(cuts):
                    end = at + int(cuts[-1]) + 1
                else:  # one word fills the stretch
                    end = min((k for k in (data.find(bytes([b]), end) for b in GAPS + BREAKS) if k >= 0), default=len(data))
            found.append(self._stretch(data, at, end))
            at = end
        if not found:
            return np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3
        sums, starts, ends = (np.concatenate([f[k] for f in found]) for k in range(3))
        breaks = np.concatenate([f[3] for f in found]) + np.repeat(np.cumsum([0, *(f[4] for f in found[:-1])]), [len(f[3]) for f in found])
        of_lang = np.uint64(_number(self.seed, b"lang", lang.encode("utf-8", "surrogatepass")))
        ids = mix(sums + of_lang + (ends - starts).astype(np.uint64) * self.of_byte[0])
        long = np.flatnonzero(ends - starts > PLAIN)
        ids[long] = [_number(self.seed, lang.encode("utf-8", "surrogatepass"), data[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist())]
        return ids, np.arange(len(ids)) + breaks, starts, ends

    def _stretch(self, data: bytes, at: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        some = np.frombuffer(data, np.uint8, end - at, at)
        kinds = KINDS[some]
        edges = np.flatnonzero(np.diff(kinds == 0, prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        self._powers(len(some) + 1)
        total = np.concatenate([[np.uint64(0)], np.cumsum(self.of_byte[some] * self.up[: len(some)], dtype=np.uint64)])
        breaks = np.cumsum(kinds == 2)
        return (total[ends] - total[starts]) * self.down[starts], starts + at, ends + at, breaks[starts], int(breaks[-1])


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, bytes]]:
    """Batches of (lang, text) to texts of one language in lower case, with breaks between them. At most about 2 * size bytes wait."""
    waiting: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}

    def flush(lang: str) -> tuple[str, bytes]:
        del sizes[lang]
        return lang, b"\n".join(waiting.pop(lang)).translate(LOWER)

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            if not data:
                continue
            waiting.setdefault(lang, []).append(data)
            sizes[lang] = sizes.get(lang, 0) + len(data)
            if sizes[lang] >= size:
                yield flush(lang)
            elif sum(sizes.values()) >= 2 * size:
                yield flush(max(sizes, key=sizes.get))
    for lang in [*waiting]:
        yield flush(lang)


def runs_of(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal rows of `keys` together, and where each run of equal rows starts.

    Rows of different keys with one hash may interrupt each other: a key then has several runs, which are added up with those of other blocks.
    """
    code = keys[0]
    for k in keys[1:]:
        code = mix(code * np.uint64(0x9E3779B97F4A7C15) + k)
    order = np.argsort(code)
    new = np.zeros(len(code), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, np.flatnonzero(new)


def slots(ids: list[np.ndarray], bits: int) -> np.ndarray:
    """As `slot`, in numpy."""
    out = ids[0]
    for k in ids[1:]:
        out = (out << np.uint64(23) | out >> np.uint64(41)) ^ k
    return out & np.uint64((1 << bits) - 1)


def slot(ids: list[Column]) -> Column:
    """A number whose low bits spread phrases evenly: the ids are hashes already."""
    turned = lambda x: F.shiftleft(x, 23).bitwiseOR(F.shiftrightunsigned(x, 41))
    return reduce(lambda out, k: turned(out).bitwiseXOR(k), ids)


def passing(ids: list[np.ndarray], bits: np.ndarray) -> np.ndarray:
    at = slots(ids, int(len(bits) * 8).bit_length() - 1)
    return bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0


def extend(ends: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge join of the positions after `ends` with postings, both ascending: which occurrences go on, and with which posting."""
    at = np.searchsorted(positions, ends + 1)
    at[at == len(positions)] = 0
    goes_on = np.flatnonzero(positions[at] == ends + 1) if len(positions) else np.empty(0, np.int64)
    return goes_on, at[goes_on]


def read_words(batches: Iterator[pa.RecordBatch], seed: int, size: int) -> Iterator[pa.RecordBatch]:
    """A row for each word of each block: lang, word, id, n."""
    scan = Scanner(seed)
    for lang, data in blocks(batches, size):
        ids, _, starts, ends = scan(lang, data)
        ids, first, n = np.unique(ids, return_index=True, return_counts=True)
        words = [data[a:b].decode("utf-8", "surrogatepass") for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words, pa.string()), pa.array(ids.view(np.int64)), pa.array(n)], ["lang", "word", "id", "n"])


def read_phrases(batches: Iterator[pa.RecordBatch], seed: int, size: int, frequent: list) -> Iterator[pa.RecordBatch]:
    """A row for each phrase of k words of each block, whose first and last k - 1 words may be frequent: w1 ... wk, n.

    `frequent` has the bitmaps (as broadcasts) of the frequent phrases of 1 to k - 1 words.
    """
    scan, allowed = Scanner(seed), [np.frombuffer(b.value, np.uint8) for b in frequent]
    for lang, data in blocks(batches, size):
        ids, positions, _, _ = scan(lang, data)
        kept = passing([ids], allowed[0])
        ids, positions = ids[kept], positions[kept]
        phrase, ends = [ids], positions  # occurrences of phrases of one word
        for level in range(1, len(allowed) + 1):
            goes_on, posting = extend(ends, positions)
            phrase, ends = [*(w[goes_on] for w in phrase), ids[posting]], positions[posting]
            for part in (phrase,) if level < len(allowed) else (phrase[1:],):
                kept = passing(part, allowed[len(part) - 1])
                phrase, ends = [w[kept] for w in phrase], ends[kept]
        order, starts = runs_of(phrase)
        n = np.diff(starts, append=len(order))
        columns = [pa.array(w[order[starts]].view(np.int64)) for w in phrase]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(n)], [*(f"w{k + 1}" for k in range(len(phrase))), "n"])


def _exact(count: Column) -> Column:
    return count.cast("decimal(20,0)")


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, cover: int = COVER, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """All candidates (lang, phrase, words, a, l, r, score, covered), and the words of each language (lang, n). Runs jobs.

    `a`, `l` and `r` are the frequencies of the phrase and of its parts at the cut with the lowest score. A candidate is `covered` if a longer candidate that holds it has
    `cover` per cent of its frequency. A null language is `und`; null and empty texts have no words; equal texts count each. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    whole_texts(spark)
    texts, seed = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text").where("text <> ''"), 0
    while True:
        found = texts.mapInArrow(partial(read_words, seed=seed, size=block), "lang string, word string, id long, n long")
        words = cut(found.groupBy("lang", "word", "id").agg(F.sum("n").alias("n")))
        if words.groupBy("id").count().where("count > 1").isEmpty():
            break
        seed += 1  # two words share an id
    levels = [words.where(F.col("n") >= least).select(F.array("id").alias("ids"), "lang", F.col("word").alias("phrase"), "n")]
    sets = [spark.sparkContext.broadcast(bitmap(levels[0].select(F.col("ids")[0].alias("slot")), "slot", WORD_BITS))]
    for k in range(2, longest + 1):
        names = [f"w{i + 1}" for i in range(k)]
        found = texts.mapInArrow(partial(read_phrases, seed=seed, size=block, frequent=[*sets]), ", ".join(f"{c} long" for c in [*names, "n"]))
        counted = cut(found.groupBy(*names).agg(F.sum("n").alias("n")).where(F.col("n") >= least))
        levels.append(counted.select(F.array(*names).alias("ids"), "n"))
        if k < longest:
            sets.append(spark.sparkContext.broadcast(bitmap(counted.select(slot([F.col(c) for c in names]).alias("slot")), "slot", PHRASE_BITS)))
    out = [_scored(levels, k) for k in range(2, longest + 1)]
    inside = [_inside(levels[k - 1], k) for k in range(3, longest + 1)]
    candidates = reduce(DataFrame.unionByName, out)
    if inside:
        most = reduce(DataFrame.unionByName, inside).groupBy("ids").agg(F.max("n").alias("longer"))
        candidates = candidates.join(most, "ids", "left").withColumn("covered", F.coalesce(100 * F.col("longer") >= cover * F.col("a"), F.lit(False))).drop("longer")
    else:
        candidates = candidates.withColumn("covered", F.lit(False))
    return candidates.withColumn("words", F.size("ids")).drop("ids"), words.groupBy("lang").agg(F.sum("n").alias("n"))


def _scored(levels: list[DataFrame], k: int) -> DataFrame:
    """Phrases of k words with their language, text and the parts of their lowest cut. Gives levels[k - 1] its texts.

    Many candidates may share a part; these are inner joins with one row per part, whose skewed partitions adaptive execution splits.
    """
    out, cuts = levels[k - 1].withColumnRenamed("n", "a"), []
    for i in range(1, k):
        for name, part, length in (("l", F.slice("ids", 1, i), i), ("r", F.slice("ids", i + 1, k - i), k - i)):
            texts = [F.col(c).alias(f"{name}{i}_{c}") for c in ("lang", "phrase") if (name == "l" and i == k - 1) or (c == "phrase" and name == "r" and i == k - 1)]
            right = levels[length - 1].select(F.col("ids").alias("_part"), F.col("n").alias(f"{name}{i}"), *texts)
            out = out.withColumn("_part", part).join(right, "_part").drop("_part")
        a, l, r = F.col("a"), F.col(f"l{i}"), F.col(f"r{i}")  # noqa: E741
        out = out.withColumn("_top", F.lit(1_000_000).cast("decimal(7,0)") * _exact(a) * _exact(a)).withColumn("_under", _exact(l) * _exact(r))
        out = out.withColumn(f"score{i}", F.expr("_top div _under"))
        cuts.append(F.struct(F.col(f"score{i}").alias("score"), F.lit(i).alias("k"), l.alias("l"), r.alias("r")))
    phrase = F.concat_ws(" ", f"l{k - 1}_phrase", f"r{k - 1}_phrase")
    out = out.select("ids", F.col(f"l{k - 1}_lang").alias("lang"), phrase.alias("phrase"), "a", F.array_min(F.array(*cuts)).alias("cut"))
    levels[k - 1] = out.select("ids", "lang", "phrase", F.col("a").alias("n"))
    return out.select("ids", "lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def _inside(level: DataFrame, k: int) -> DataFrame:
    """The phrases of 2 to k - 1 words inside each phrase of k words, with its frequency."""
    parts = [F.slice("ids", i + 1, m) for m in range(2, k) for i in range(k - m + 1)]
    return level.select(F.explode(F.array(*parts)).alias("ids"), "n")


def collocations(docs: DataFrame, top: int = TOP, **how) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` candidates of each language that no longer one covers; `how` and all cases as for `mine`.

    By score, then frequency, both falling, then phrase. `n` is the number of words of the language. Languages without candidates have no rows.
    """
    found, sizes = mine(docs, **how)
    by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    found = found.where("NOT covered").withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    first = found.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*by))).where(F.col("_rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
