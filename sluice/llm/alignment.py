"""Aligning the tokens of two vocabularies by a dangling-suffix transducer.

The tokens of both sides spell the same bytes. The transducer's state is which side leads and the bytes by which it leads. It reads the next
token of the side that lags: the token is a prefix of those bytes, and they become shorter, or they are a prefix of the token, and the sides change
places with what is left of it. Where nothing is left both sides end a token, and a group of tokens closes. A transition depends on the state and
the token alone and is kept once seen. Bytes that disagree have no transition.

Both vocabularies end a token where `vocab.CUT` finds a space, so the transducer is at rest there, and what it says of a word holds wherever the
word stands; words seen lately are not aligned again.

Links of a pair of ids are counted in documents of the whole corpus. Texts are read once, in blocks of about `BLOCK` characters: a block keeps its
documents as sequences of its own words, the links of each word, and how many of its documents hold each pair linked. Pairs are summed over blocks, each
block gets back the counts of its own pairs, and from them the documents' figures follow. A pair has at most one row a block, a block's rows are bounded by
its characters, and nothing is broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vocab
from .common import cut, whole_texts

LEFT, RIGHT = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of a block, of texts whose words are looked up together, and of the words a worker keeps.
BLOCK, RUN, KNOWN = 6 << 20, 1 << 20, 1_800_000
#: Transitions a worker keeps.
STEPS = 500_000

FIGURES = ("n_a", "n_b", "n_groups", "n_links")


class Transducer:
    """Groups of tokens from two lists of ids; `a` and `b` give the bytes of ids."""

    REST = (1, b"")  # the right side leads by nothing: the left side's turn

    def __init__(self, a, b) -> None:
        self.sides = (b, a)  # by the side that leads: whose token is next
        self.reset()

    def reset(self) -> None:
        self.numbers, self.states, self.leads, self.steps, self.n = {self.REST: 0}, [self.REST], [self.REST[0]], [{}], 0

    def _step(self, state: int, token: int) -> int:
        """The next state, -1 where bytes disagree."""
        lead, ahead = self.states[state]
        new = self.sides[lead][token]
        if ahead.startswith(new):
            then = (lead, ahead[len(new) :])
        elif new.startswith(ahead):
            then = (1 - lead, new[len(ahead) :])
        else:
            then = None
        number = -1 if then is None else 0 if not then[1] else self.numbers.setdefault(then, len(self.states))
        if number == len(self.states):
            self.states.append(then)
            self.leads.append(then[0])
            self.steps.append({})
        self.steps[state][token] = number
        self.n += 1
        return number

    def groups(self, a: list[int], b: list[int], sizes: list[tuple[int, int]]) -> tuple[list[int], list[int], list[int]]:
        """For words one after the other, of so many tokens of each side: how many tokens of either side there are up to the end of each group, and how many groups a word has.

        A word whose sides spell different bytes has no groups, and -1 as their number.
        """
        if self.n > STEPS:
            self.reset()
        steps, leads, i, j, left, right, found = self.steps, self.leads, 0, 0, [], [], []
        for na, nb in sizes:
            i_end, j_end, state, before = i + na, j + nb, 0, len(left)
            while state >= 0:
                if leads[state]:
                    if i == i_end:
                        break
                    token = a[i]
                    i += 1
                else:
                    if j == j_end:
                        break
                    token = b[j]
                    j += 1
                then = steps[state].get(token)
                state = self._step(state, token) if then is None else then
                if not state:
                    left.append(i)
                    right.append(j)
            if state or i < i_end or j < j_end:
                del left[before:], right[before:]
                found.append(-1)
            else:
                found.append(len(left) - before)
            i, j = i_end, j_end
        return left, right, found


class Aligner:
    """What a worker knows of words: n_a, n_b, n_groups, n_links, the groups as text, and the links (pairs of ids as numbers, as bytes). None for words that one side does not spell."""

    def __init__(self, left: str, right: str) -> None:
        self.a, self.b = vocab.ByteLevel(left), vocab.Pieces(right)
        self.cuts = self.a.cuts and self.b.cuts
        self.transducer = Transducer(self.a.bytes, self.b.bytes)
        self.known = vocab.Memo(self.learn, KNOWN)
        top = 1 + max(*self.a.bytes, len(self.b.bytes))
        self.text = np.array([[f"{i}{sep}" for i in range(top)] for sep in ("", ",", "|", ";")], object)

    def learn(self, words: list[str]) -> dict[str, tuple | None]:
        if not words:
            return {}
        left, right = self.a.encode_words(words), self.b.encode(words)
        a = np.frombuffer(b"".join(map(left.__getitem__, words)), "<u4").astype(np.int64)
        b = np.fromiter(chain.from_iterable(right), np.int64)
        na, nb = [len(left[w]) // 4 for w in words], [*map(len, right)]
        ids = a.tolist()
        left, right, found = self.transducer.groups(ids, b.tolist(), [*zip(na, nb)])
        spelled = [*map(self.a.bytes.__getitem__, ids)]
        if b"".join(spelled) != b"".join(b" " + w.encode() for w in words):
            ends = np.cumsum(na).tolist()
            found = [-1 if b"".join(spelled[e - n : e]) != b" " + w.encode() else f for w, n, e, f in zip(words, na, ends, found)]
        return dict(zip(words, self._entries(a, b, np.array(na), np.array(nb), np.array(left, np.int64), np.array(right, np.int64), np.array(found))))

    def _entries(self, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, left: np.ndarray, right: np.ndarray, found: np.ndarray) -> Iterator[tuple | None]:
        """Of all words at once. A word without groups stands in `a` and `b` and has none in `left` and `right`, so tokens are taken by group."""
        word = np.repeat(np.arange(len(found)), np.maximum(found, 0))
        first_a, first_b = np.cumsum(na) - na, np.cumsum(nb) - nb
        begins = np.diff(word, prepend=-1) > 0  # of groups: the first of a word
        start_a = np.where(begins, first_a[word], np.concatenate([[0], left[:-1]]))
        start_b = np.where(begins, first_b[word], np.concatenate([[0], right[:-1]]))
        p, q = left - start_a, right - start_b
        # text: the tokens of a group's left side, then those of its right side, each with what follows it
        at_a, at_b = places(start_a, p), places(start_b, q)
        order = np.cumsum(p + q) - (p + q)
        texts = np.empty(int((p + q).sum()), object)
        sep_a, sep_b = np.ones(len(at_a), np.int8), np.ones(len(at_b), np.int8)
        sep_a[np.cumsum(p) - 1], sep_b[np.cumsum(q) - 1] = 2, np.where(np.diff(word, append=-1) != 0, 0, 3)
        texts[places(order, p)] = self.text[sep_a, a[at_a]]
        texts[places(order + p, q)] = self.text[sep_b, b[at_b]]
        # links: every left token of a group with every right one
        rows = np.repeat(np.arange(len(p)), p * q)
        k = places(np.zeros(len(p), np.int64), p * q)
        links = (a[start_a[rows] + k // q[rows]] << 32 | b[start_b[rows] + k % q[rows]]).tobytes()
        n_links = np.bincount(word, p * q, len(found)).astype(np.int64)
        n_texts = np.bincount(word, p + q, len(found)).astype(np.int64)
        texts, at, of = texts.tolist(), 0, 0
        for x, y, g, n, m in zip(na.tolist(), nb.tolist(), found.tolist(), n_links.tolist(), n_texts.tolist()):
            yield (x, y, g, n, "".join(texts[at : at + m]), links[of : of + 8 * n]) if g >= 0 and m else None
            at, of = at + m, of + 8 * n


def places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class Block:
    """Documents of a task as sequences of numbered words, with the figures and links of each word, and their pairs counted."""

    NOTHING = (0, 0, 0, 0, "", b"")

    def __init__(self) -> None:
        self.numbers: dict[str | tuple[str], int] = {}
        self.said, self.links = [], []
        self.of_word, self.odd = np.empty((0, 4), np.int64), np.empty(0, bool)
        self.ids, self.figures, self.digests, self.sequences = [], [], [], []
        self.pairs, self.holders, self.chars = np.empty(0, np.int64), np.empty(0, np.int64), 0

    def _learn(self, entries: dict) -> None:
        """Number these words."""
        for w, e in entries.items():
            self.numbers[w] = len(self.numbers)
            self.said.append((e or self.NOTHING)[4])
            self.links.append((e or self.NOTHING)[5])
        if entries:
            self.of_word = np.concatenate([self.of_word, [(e or self.NOTHING)[:4] for e in entries.values()]])
            self.odd = np.concatenate([self.odd, [e is None for e in entries.values()]])

    def add(self, ids: pa.Array, texts: list[str | None], aligner: Aligner) -> None:
        split = [(vocab.CUT.split(t) if aligner.cuts else [t]) if t else [] for t in texts]
        new = set().union(*split).difference(self.numbers)
        aligner.known.need(new)
        self._learn({w: aligner.known[w] for w in new})
        sequences = [np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)) for words in split]
        for k in np.flatnonzero([self.odd[s].any() for s in sequences]):  # a word's sides differ: they may yet agree on the whole text
            whole = aligner.learn([texts[k]])[texts[k]]
            if whole:
                self._learn({(texts[k],): whole} if (texts[k],) not in self.numbers else {})
            sequences[k] = np.array([self.numbers[(texts[k],)]] if whole else [], np.int32)
        sizes = np.array([len(s) for s in sequences], np.int64)
        words = np.concatenate([*sequences, np.empty(0, np.int32)])
        self.figures.append(np.stack([sums(self.of_word[words, k], sizes) for k in range(4)], 1))
        self.digests += [sha256(";".join(map(self.said.__getitem__, s.tolist())).encode()).hexdigest() if len(s) else "" for s in sequences]
        self.ids.append(ids)
        self.sequences += sequences
        self.chars += sum(len(t or "") for t in texts)
        self._count(sequences)

    def _count(self, sequences: list[np.ndarray]) -> None:
        """Documents that hold each pair, added to those so far."""
        doc = np.repeat(np.arange(len(sequences)), [len(s) for s in sequences])
        held = np.unique(doc * len(self.links) + np.concatenate(sequences)) if len(doc) else doc
        if not len(held):
            return
        doc, word = np.divmod(held, len(self.links))
        words, place = np.unique(word, return_inverse=True)
        lists = [self.links[w] for w in words.tolist()]
        flat, start, size = flatten(lists)
        pairs, number = np.unique(flat, return_inverse=True)
        many = size[place]
        into = places(start[place], many)
        held = np.unique(np.repeat(doc, many) * len(pairs) + number[into])
        holders = np.bincount(held % len(pairs), minlength=len(pairs))
        merged, back = np.unique(np.concatenate([self.pairs, pairs]), return_inverse=True)
        self.holders = np.bincount(back, np.concatenate([self.holders, holders]), len(merged)).astype(np.int64)
        self.pairs = merged

    def row(self, number: int) -> list[pa.Array]:
        one = lambda values: pa.array([values])
        flat, _, size = flatten(self.links)
        sequence = np.concatenate([*self.sequences, np.empty(0, np.int32)])
        sizes, figures = np.array([len(s) for s in self.sequences]), np.concatenate(self.figures)
        packed = [zlib.compress(x.astype("<i4").tobytes(), 1) for x in (sequence, sizes, np.searchsorted(self.pairs, flat), size)]
        ids = pa.concat_arrays(self.ids)
        documents = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        figures = [pa.array([figures[:, k]], pa.list_(pa.int64())) for k in range(4)]
        digests = pa.array([self.digests], pa.list_(pa.string()))
        counts = [pa.array([x], pa.list_(pa.int64())) for x in (self.pairs, self.holders)]
        return [one(number), documents, *figures, digests, *map(one, packed), *counts]


def flatten(links: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All numbers, where those of each word start, and how many they are."""
    size = np.fromiter(map(len, links), np.int64, len(links)) // 8
    return np.frombuffer(b"".join(links), np.int64), np.cumsum(size) - size, size


NAMES = ["block", "doc_id", *FIGURES, "groups_sha256", "words", "sizes", "links", "link_sizes", "pairs", "holders"]

_aligners: dict[tuple[str, str], Aligner] = {}


def read_blocks(batches: Iterator[pa.RecordBatch], left: str, right: str, most: int) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, text) to blocks."""
    aligner = _aligners.get((left, right)) or _aligners.setdefault((left, right), Aligner(left, right))
    number, block = TaskContext.get().partitionId() << 32, Block()
    for batch in batches:
        at = 0
        for texts in vocab.runs(batch.column(1), RUN):
            block.add(batch.column(0).slice(at, len(texts)), texts, aligner)
            at += len(texts)
            if block.chars >= most:
                yield pa.RecordBatch.from_arrays(block.row(number), NAMES)
                number, block = number + 1, Block()
    if block.figures:
        yield pa.RecordBatch.from_arrays(block.row(number), NAMES)


def score_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with `counts` and `best`, in the order of their pairs, to a row a document."""
    for batch in batches:
        for k in range(batch.num_rows):
            column = {name: batch.column(name)[k] for name in batch.schema.names}
            words, sizes, links, link_sizes = (np.frombuffer(zlib.decompress(column[c].as_py()), "<i4") for c in ("words", "sizes", "links", "link_sizes"))
            given = [column[c].values.to_numpy(zero_copy_only=False) if column[c].is_valid else np.empty(0, np.int64) for c in ("counts", "best")]
            figures = []
            for per_pair in (given[0] == given[1], given[0]):
                per_word = sums(per_pair[links].astype(np.int64), link_sizes)
                figures.append(pa.array(sums(per_word[words], sizes)))
            columns = [column[c].values for c in ("doc_id", *FIGURES, "groups_sha256")] + figures
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *FIGURES, "groups_sha256", "n_best", "count_sum"])


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of runs of these sizes; a run may be empty."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def align(docs: DataFrame, left: str = LEFT, right: str = RIGHT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: a row a document. Runs a job.

    `left` is a byte-level vocabulary of `tokenizers`, `right` one of `sentencepiece`. Null and empty texts, and texts that one side does not
    spell as a space and the text, have zeros and '' and count for no pair. Null and repeated ids, and equal texts, are documents like any other.
    Other columns of `docs` are not read. An empty table gives no rows.
    """
    whole_texts(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    figures = ", ".join(f"{c} array<long>" for c in FIGURES)
    schema = f"block long, doc_id array<{kind}>, {figures}, groups_sha256 array<string>, words binary, sizes binary, links binary, link_sizes binary, pairs array<long>, holders array<long>"
    blocks = cut(docs.select("doc_id", "text").mapInArrow(partial(read_blocks, left=left, right=right, most=block), schema))
    held = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "holders")).alias("place", "at")).select("block", "place", F.col("at.pairs").alias("pair"), F.col("at.holders").alias("holders"))
    total = held.groupBy("pair").agg(F.sum("holders").alias("count"))
    best = F.max("count").over(Window.partitionBy(F.shiftright("pair", 32)))  # of one id: at most a row for each id of the other side
    total = total.withColumn("best", best)
    back = held.drop("holders").join(total, "pair").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "count", "best"))).alias("got"))
    back = back.select("block", F.col("got.count").alias("counts"), F.col("got.best").alias("best"))
    out = f"doc_id {kind}, {', '.join(f'{c} long' for c in FIGURES)}, groups_sha256 string, n_best long, count_sum long"
    scored = blocks.drop("pairs", "holders").join(back, "block", "left").mapInArrow(score_blocks, out)
    return scored.select("doc_id", *FIGURES, "n_best", "count_sum", "groups_sha256")
