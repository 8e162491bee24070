"""Benchmark decontamination by template canonicalisation.

Numbers, units and names become typed placeholders, so that a question and a copy with other figures or people have one template. Windows of
K canonical words of every document are hash-joined to those of the benchmark; where enough of an item is found, its slots are compared:
each value of the item must stand for one value of the document throughout. Then the copy is the same question, verbatim or re-parameterised.
A document may hold an item more than once, or several items of one template, with other values each time: slots are compared occurrence by occurrence.

A name is any capitalised word, at the start of a sentence too: there it can't be told from an ordinary word, and as a placeholder of its own it matches
either. Numbers in figures and in words are one kind of placeholder; "two hundred" is one number. The map of slot values is one-to-one: two values of the item that
become one value of the document are no consistent copy.

Items too poor in words for templates (short, or mostly figures) are matched as a whole instead: all their tokens in a row, signs included. If such an item
has PAIR words or more and `figures` is set, its numbers may be others; else it must stand there verbatim.

One scan of whole texts emits only windows whose hash passes a bitmap of fixed size built from the benchmark; the join with
the benchmark's windows, which is exact, follows on those few rows.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap, cut, hide, shown, whole_texts
from .hashing import Words, mix, rolling

K = 8
#: Items with fewer canonical words than this, or without a firm window, are searched for verbatim.
LEAST = 4
#: Words other than placeholders that a window must have.
FIRM = 3
#: Words that an item without a template must have for its numbers to be placeholders.
PAIR = 2
#: Share of an item's windows that must be found, or else RUN windows in a row.
COVERAGE = 0.5
RUN = 13
#: Share of an item's slot values that must stand for one value each.
CONSISTENT = 0.8
BITS = 24
UNITS = frozenset(
    "% percent km m cm mm mi mile miles foot feet ft inch inches yard yards kg g mg lb lbs pound pounds ounce ounces oz ton tons tonne tonnes l ml liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros degree degrees kb mb gb tb bytes watt watts volt volts joule joules newton newtons hz khz mhz ghz kmh mph".split()
)
#: Numbers in words (fixed values).
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half third quarter".split()
)
#: Words first, which most tokens are. A sign belongs to a number where nothing but a space or a bracket comes before it.
_LETTERS_OR_FIGURES = r"[^\W\d_]+|\d+(?:[.,/:]\d+)*|[-−+$€£¥](?<![^\s(].)[$€£¥]?\d+(?:[.,/:]\d+)*"
_TOKEN = re.compile(_LETTERS_OR_FIGURES + r"|[%.!?\n]")
_SIGN = re.compile(_LETTERS_OR_FIGURES + r"|\S")
_WORD, _NUMBER, _CAPITAL, _STOP, _UNIT, _SPELLED = range(6)
_NUM, _UNI, _NAME = np.uint64(8), np.uint64(16), np.uint64(24)


class Canon:
    """Texts to canonical words: 64-bit ids, of which _NUM, _UNI and _NAME are placeholders."""

    def __init__(self, most: int = 250_000) -> None:
        self.most, self.known = most, {}

    @staticmethod
    def _code(token: str) -> int:
        if token[-1].isdigit():
            return _NUMBER
        if token in ".!?\n":
            return _STOP
        low = token.lower()
        kind = _UNIT if low in UNITS else _SPELLED if low in NUMBER_WORDS else _CAPITAL if token[0].isupper() and not (len(token) > 1 and token.isupper()) else _WORD
        return struct.unpack("<Q", blake2b(low.encode("utf-8", "surrogatepass"), digest_size=8).digest())[0] & ~63 | 32 | kind

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(ids, for each its first token, tokens). A number is <num>, a unit after one <unit>, capitalised words in a row one <name>."""
        tokens = _TOKEN.findall(text or "")
        known = self.known
        if len(known) > self.most:
            known.clear()
        for t in set(tokens).difference(known):
            known[t] = self._code(t)
        codes = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
        kind = (codes & np.uint64(7)).astype(np.int8)
        before = np.r_[np.int8(_STOP), kind[:-1]] if len(kind) else kind
        ids = codes & ~np.uint64(7)
        name, number = kind == _CAPITAL, (kind == _NUMBER) | (kind == _SPELLED)
        after_number = np.r_[False, number[:-1]] if len(kind) else number
        ids[number] = _NUM
        ids[(kind == _UNIT) & after_number] = _UNI
        ids[name] = _NAME
        inner = name & (before != _STOP)  # the first word of a sentence may be no name: it is a placeholder of its own
        more = (name & np.r_[False, inner[:-1]] if len(kind) else name) | ((kind == _SPELLED) & after_number)
        keep = (kind != _STOP) & ~more
        at = np.flatnonzero(keep)
        return ids[at], at, tokens


def windows(ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the windows with at least FIRM words that are no placeholder."""
    if len(ids) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes, names = rolling(ids, width), ids < 32
    if not names.any():
        return hashes, np.arange(len(hashes))
    firm = np.cumsum(np.r_[0, ~names])
    at = np.flatnonzero(firm[width:] - firm[:-width] >= FIRM)
    return hashes[at], at


def slots(canon: tuple, start: int, width: int) -> list[str]:
    """The values in the window's placeholders, in order, each with its type."""
    ids, at, tokens = canon
    out = []
    for i in range(start, start + width):
        if ids[i] < 32:
            end = at[i] + 1
            last = at[i + 1] if i + 1 < len(at) else len(tokens)
            while end < last and tokens[end] not in ".!?\n":
                end += 1
            out.append(f"{'num' if ids[i] == _NUM else 'unit' if ids[i] == _UNI else 'name'}:{' '.join(tokens[at[i] : end]).lower()}")
    return out


class Verbatim:
    """Texts to ids of all their tokens (words in lower case, numbers, single signs), hashed apart from those of Canon. With `open`, numbers are placeholders; the tokens come too."""

    def __init__(self) -> None:
        self.words = Words()

    def __call__(self, text: str | None, bare: bool = False, open: bool = False) -> tuple[np.ndarray, list[str]]:
        """`bare`: without signs at either end, unless there is nothing else."""
        tokens = _SIGN.findall((text or "").lower())
        if bare:
            word = [k for k, t in enumerate(tokens) if t[-1].isalnum()]
            tokens = tokens[word[0] : word[-1] + 1] if word else tokens
        said = [OPEN if open and (t[-1].isdigit() or t in NUMBER_WORDS) else t for t in tokens]
        return mix(self.words.ids([t.encode("utf-8", "surrogatepass") for t in said])), tokens


#: What a number is among the tokens of an open item; no token is like it.
OPEN = "<num>"


def numbers(tokens: list[str]) -> list[str]:
    return [f"num:{t}" for t in tokens if t[-1].isdigit() or t in NUMBER_WORDS]


_ITEMS = "n int, length int, exact boolean, open boolean, width int, hash long, pos int, want array<string>"


def item_windows(bench: DataFrame, figures: bool = False) -> DataFrame:
    """A row per window of each item (columns _item and _text): its hash, position and slot values, and the item's numbers of windows and of canonical words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        canon, verbatim = Canon(), Verbatim()
        for batch in batches:
            rows = []
            for item, text in zip(batch["_item"], batch["_text"], strict=True):
                whole = canon(text)
                width = min(K, len(whole[0]))
                hashes, at = windows(whole[0], width) if width >= LEAST else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                if len(hashes):
                    rows += [(item, len(hashes), len(whole[0]), False, False, width, h, p, slots(whole, p, width)) for h, p in zip(hashes.view(np.int64).tolist(), at.tolist(), strict=True)]
                else:
                    _, tokens = verbatim(text, bare=True)
                    open = figures and bool(numbers(tokens)) and sum(t[0].isalpha() and t not in NUMBER_WORDS for t in tokens) >= PAIR
                    ids, _ = verbatim(text, bare=True, open=open)
                    hashes, width = rolling(ids, K), min(K, len(ids))
                    rows += [(item, len(hashes), len(ids), True, open, width, h, p, numbers(tokens[p : p + width]) if open else []) for p, h in enumerate(hashes.view(np.int64).tolist())]
            yield pd.DataFrame(rows, columns=["item", "n", "length", "exact", "open", "width", "hash", "pos", "want"])

    kind = bench.schema["_item"].dataType.simpleString()
    return bench.select("_item", "_text").mapInPandas(run, f"item {kind}, {_ITEMS}")


def _hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Windows of documents (columns _row and _text) whose hash may be one of `items`."""
    sorts = sorted((r[0], r[1], r[2]) for r in items.select("exact", "open", "width").distinct().collect())  # at most 3 K values
    exact = {o for e, o, _ in sorts if e}
    bits = np.frombuffer(bitmap(items, "hash", BITS), np.uint8)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        canon, verbatim, mask = Canon(), Verbatim(), np.uint64((1 << BITS) - 1)
        for batch in batches:
            rows = []
            for row, text in zip(batch["_row"], batch["_text"], strict=True):
                whole = canon(text)
                every = {o: verbatim(text, open=o) for o in exact}
                for own, open, width in sorts:
                    if own:
                        ids, tokens = every[open]
                        hashes = rolling(ids, width) if len(ids) >= width else ids[:0]
                        at = np.arange(len(hashes))
                    else:
                        hashes, at = windows(whole[0], width)
                    b = (hashes & mask).astype(np.int64)
                    for i in np.flatnonzero((bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1):
                        rows.append((row, int(hashes[i].view(np.int64)), int(at[i]), (numbers(tokens[i : i + width]) if open else []) if own else slots(whole, int(at[i]), width)))
            yield pd.DataFrame(rows, columns=["_row", "hash", "at", "got"])

    return docs.mapInPandas(run, "_row long, hash long, at int, got array<string>")


def _occurrences(hits: DataFrame) -> DataFrame:
    """`hits` with the occurrence `occ` of the item that each belongs to, in three readings where hits lie on several shifts (`at` - `pos`).

    An occurrence is what lies on one shift; or on shifts less than half an item apart (words put in or left out), as
    occurrences side by side are a whole item apart; or all of the document (an item in pieces far apart). A verbatim
    item's lies on one shift.
    """
    of = Window.partitionBy("_row", "item")
    hits = hits.withColumn("shift", F.col("at") - F.col("pos"))
    fresh = (F.col("shift") - F.lag("shift").over(of.orderBy("shift")) >= F.greatest(F.lit(2), F.col("length") / 2)).cast("int")
    hits = hits.withColumn("_fresh", F.coalesce(fresh, F.lit(0))).withColumn("_near", F.sum("_fresh").over(of.orderBy("shift")))
    hits = hits.withColumn("_one", F.min("shift").over(of) == F.max("shift").over(of))
    part = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.cast("long").alias("key"))
    whole = part("whole", F.lit(0))
    parts = F.when(F.col("exact"), F.array(part("exact", F.col("shift")))).when(F.col("_one"), F.array(whole)).otherwise(F.array(part("shift", F.col("shift")), part("near", F.col("_near")), whole))
    return hits.withColumn("occ", F.explode(parts)).drop("_fresh", "_near", "_one")


def leaks(docs: DataFrame, bench: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", coverage: float = COVERAGE, run: int = RUN, consistent: float = CONSISTENT, figures: bool = False) -> DataFrame:
    """(_row, id, item, windows, of_windows, coverage, longest, n_slots, n_consistent, verbatim): the documents that hold an item of the benchmark.

    A document holds an item when in one occurrence `coverage` of the item's windows, or `run` windows in a row, stand in it and
    `consistent` of the item's slot values stand for one value each, and no two for the same. Of several such occurrences the row gives that with the largest
    coverage, verbatim ones first. verbatim: all slot values are the item's own. Items of fewer than LEAST canonical words or without a
    window of FIRM words have no template: all their tokens must stand in a row (case and signs at the ends aside). With `figures`, their numbers are slots if they have PAIR other words or more; else they have none; so an item of one word is held by all
    documents with that word. Item ids may be of any type that can be grouped. Null and empty texts, and items without an id, match nothing. Rows that repeat an id count apart (by _row); of items that repeat an id, the windows are
    pooled. Other columns are not read.
    """
    whole_texts(docs.sparkSession)
    docs = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    items = cut(item_windows(bench.select(F.col(item).alias("_item"), F.col(text).alias("_text")).where("_item IS NOT NULL"), figures))
    hits = cut(_occurrences(_hits(docs.select("_row", "_text"), items).join(items, "hash")))
    place = ["_row", "item", "occ"]
    spots = hits.groupBy(*place, "shift", "pos").agg(F.max("n").alias("n"), F.bool_or("exact").alias("exact"))
    islands = spots.withColumn("run", F.col("pos") - F.row_number().over(Window.partitionBy(*place, "shift").orderBy("pos")))
    runs = islands.groupBy(*place, "shift", "run").agg(F.count("*").alias("k")).groupBy(*place).agg(F.max("k").alias("longest"))
    found = spots.select(*place, "pos", "n", "exact").distinct().groupBy(*place).agg(F.count("*").alias("windows"), F.max("n").alias("of_windows"), F.bool_or("exact").alias("exact"))
    values = hits.select(*place, F.explode(F.arrays_zip("want", "got")).alias("v")).groupBy(*place, "v.want").agg(F.min("v.got").alias("lo"), F.max("v.got").alias("hi"))
    one = F.col("lo") == F.col("hi")
    values = values.withColumn("alone", F.count("*").over(Window.partitionBy(*place, "lo", "hi")) == 1)
    agree = values.groupBy(*place).agg(F.count("*").alias("n_slots"), F.count_if(one & F.col("alone")).alias("n_consistent"), F.count_if(one & (F.col("lo") == F.col("want"))).alias("same"))
    out = found.join(runs, place).join(agree, place, "left").fillna(0, ["n_slots", "n_consistent", "same"])
    out = out.withColumn("coverage", F.col("windows") / F.col("of_windows")).withColumn("verbatim", F.col("same") == F.col("n_slots"))
    enough = F.when(F.col("exact"), F.col("windows") >= F.col("of_windows")).otherwise((F.col("coverage") >= coverage) | (F.col("longest") >= run))
    out = out.where(enough & (F.col("n_consistent") >= F.lit(consistent) * F.col("n_slots")))
    best = Window.partitionBy("_row", "item").orderBy(F.desc("coverage"), F.desc("verbatim"), F.desc("longest"), F.desc("n_slots"), F.desc("n_consistent"), "occ")
    out = cut(out.withColumn("_best", F.row_number().over(best)).where("_best = 1").drop("same", "exact", "occ", "_best"))
    named = docs.select("_row", "_id").join(out, "_row")
    return named.select("_row", F.col("_id").alias(id), F.col("item").alias(item), *[F.col(c).cast("long") for c in ("windows", "of_windows")], "coverage", F.col("longest").cast("long"), F.col("n_slots").cast("long"), F.col("n_consistent").cast("long"), "verbatim")


def decontaminate(docs: DataFrame, bench: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """`docs` without the rows that hold an item of the benchmark."""
    held = leaks(docs, bench, id, text, item).select(F.col("_row").alias("_held")).distinct()
    docs, names = hide(docs)
    kept = docs.withColumn("_row", F.monotonically_increasing_id()).join(held, F.col("_row") == F.col("_held"), "left_anti")
    return kept.select(*shown(names))
