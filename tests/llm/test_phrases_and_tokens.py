"""Collocations, packing and token alignment against brute force."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sluice.llm import alignment, collocations, packing, queries, vocab

from .conftest import make, saved

ODD = [
    None, "", " ", "   ", "a", " a", "a ", "  two  spaces  ", "new\nline \n mixed\t tab\r\n", "<|endoftext|> and <s> </s> <unk>", "▁under▁line ▁", "naïve Éé ça", "数字 と 漢字", "é combining",
    " nbsp 　wide em ​zero", "😀 emoji 😀", "it's they'll 12,345.67 $9", "word " * 700, "x" * 3000, "\x00 nul \x1f", "trailing\n", "\n", "a\n\n b", "ﬁ ligature ½", "don 't 's 's", "\u0085next",
]


def odd_documents(words):
    r = random.Random(4)
    pool = [t for t in ODD if t]
    mixed = [" ".join(r.choices(pool, k=3) + words(r.randint(1, 90), k)) for k in range(30)]
    rows = [(k, t) for k, t in enumerate(ODD + mixed)]
    return rows + [(None, "no id here"), (3, ODD[3]), (5, "a"), (5, "a")]


@pytest.fixture(scope="module")
def byte_level():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_words_give_the_ids_of_whole_texts(byte_level, words):
    ours, texts = vocab.ByteLevel("byte_bpe_50k.json"), [t for _, t in odd_documents(words) if t]
    pieces = vocab.Pieces("piece_bpe_32k.model")
    assert ours.cuts and ours.fast and pieces.cuts
    for t in texts:
        parts = ours.split(t)
        got = b"".join([ours.encode(parts[0]), *map(ours.encode_words(parts[1:]).__getitem__, parts[1:])])
        assert np.frombuffer(got, "<u4").tolist() == byte_level.encode(t, add_special_tokens=False).ids, t
        assert [i for p in pieces.encode(parts) for i in p] == pieces.encode(t), t


def test_memo_answers_whatever_it_has_forgotten():
    asked, memo = [], None
    memo = vocab.Memo(lambda ws: asked.append(len(ws)) or {w: w.upper() for w in ws}, 10)
    for k in range(50):
        need = {f"w{k % 7}", f"w{k}"}
        memo.need(need)
        assert all(memo[w] == w.upper() for w in need) and len(memo) < 20
    assert sum(asked) < 100


@pytest.mark.parametrize("size", [16, 1024])
def test_packing(spark, tmp_path, words, byte_level, size):
    rows = odd_documents(words)
    docs = saved(spark, tmp_path, rows).withColumn("piece", F.lit("x")).withColumn("offset", F.lit(7)).withColumn("_group", F.lit(0))
    out = packing.pack(docs, size=size, group=40).collect()
    want = Counter()
    for k, t in rows:
        ids = byte_level.encode(t or "", add_special_tokens=False).ids + [2]
        first = (len(ids) - 1) % size + 1
        edges = [0, *range(first, len(ids) + 1, size)]
        want.update((k, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for p, (a, b) in enumerate(zip(edges, edges[1:])))
    assert Counter(tuple(r)[:5] for r in out) == want
    places = defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        end = 0
        for offset, length in sorted(p):
            assert offset == end
            end += length
        assert end <= size
    assert packing.pack(docs.limit(0)).count() == 0


def test_each_piece_goes_where_the_sum_of_squares_is_smallest():
    r = np.random.default_rng(3)
    for size, n in ((12, 200), (60, 200)):
        lengths = r.integers(1, size + 1, n)
        sequence, offset = packing.sum_of_squares(lengths, size)
        gaps, square = {}, lambda g: sum(c * c for c in Counter(x for x in g if x).values())
        for i in sorted(range(n), key=lambda i: -lengths[i]):
            need, now = int(lengths[i]), int(sequence[i])
            fitting = {g: square([*(x for j, x in gaps.items() if j != next(k for k in gaps if gaps[k] == g)), g - need]) for g in set(gaps.values()) if g >= need}
            if not fitting:
                assert now not in gaps and offset[i] == 0
                gaps[now] = size
            else:
                assert fitting[gaps[now]] == min(fitting.values()) and offset[i] == size - gaps[now]
            gaps[now] -= need


def test_packing_comes_near_the_bound():
    lengths = np.random.default_rng(5).integers(1, 1025, 20_000)
    sequence, offset = packing.sum_of_squares(lengths, 1024)
    assert (np.bincount(sequence, lengths) <= 1024).all() and (offset + lengths <= 1024).all()
    assert sequence.max() + 1 <= 1.01 * lengths.sum() / 1024


def brute_alignment(rows, byte_level):
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    alphabet = {c: b for c, b in zip([*map(chr, [*range(33, 127), *range(161, 173), *range(174, 256)])], [*range(33, 127), *range(161, 173), *range(174, 256)])}
    alphabet |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in alphabet.values())}
    left = lambda i: bytes(alphabet[c] for c in byte_level.id_to_token(i))
    right = lambda i: bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()
    out, holders = [], Counter()
    for k, t in rows:
        a, b, groups, links = [], [], [], Counter()
        if t:
            a, b = byte_level.encode(" " + t, add_special_tokens=False).ids, pieces.encode(t)
            x, y = [*map(left, a)], [*map(right, b)]
            if b"".join(x) == b"".join(y) == (" " + t).encode():
                ends = [list(itertools.accumulate(map(len, s))) for s in (x, y)]
                start = [0, 0]
                for end in sorted(set(ends[0]) & set(ends[1])):
                    stop = [e.index(end) + 1 for e in ends]
                    groups.append((a[start[0] : stop[0]], b[start[1] : stop[1]]))
                    links.update(itertools.product(*groups[-1]))
                    start = stop
            else:
                a = b = []
        holders.update(links.keys())
        said = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((k, len(a), len(b), len(groups), links, sha256(said.encode()).hexdigest() if groups else ""))
    best = Counter()
    for (i, _), n in holders.items():
        best[i] = max(best[i], n)
    return Counter((k, na, nb, ng, sum(l.values()), sum(n for p, n in l.items() if holders[p] == best[p[0]]), sum(n * holders[p] for p, n in l.items()), h) for k, na, nb, ng, l, h in out)


@pytest.mark.parametrize("block", [50, 6 << 20])
def test_alignment(spark, tmp_path, words, byte_level, block):
    rows = odd_documents(words)
    docs = saved(spark, tmp_path, rows).withColumn("n_a", F.lit("x")).withColumn("pairs", F.lit(7)).withColumn("block", F.lit(0))
    out = alignment.align(docs, block=block).collect()
    want = brute_alignment(rows, byte_level)
    assert Counter(map(tuple, out)) == want
    assert any(r.n_a and r.n_groups < r.n_a for r in out) and sum(not r.n_a for r in out) > 2
    assert alignment.align(docs.limit(0)).count() == 0


def test_transducer_forgets_without_harm(monkeypatch):
    monkeypatch.setattr(alignment, "STEPS", 3)
    a, b = {0: b"ab", 1: b"c", 2: b"de", 3: b"x"}, {0: b"a", 1: b"bcd", 2: b"e", 3: b"abcde"}
    t = alignment.Transducer(a, b)
    for _ in range(3):
        assert t.groups([0, 1, 2], [0, 1, 2], [(3, 3)]) == ([3], [3], [1]) and t.groups([0, 1, 2, 1], [3, 3], [(4, 2)]) == ([], [], [-1])
        assert t.groups([0, 1, 2], [3], [(3, 1)]) == ([3], [1], [1]) and t.groups([], [], [(0, 0)]) == ([], [], [0])
        assert t.groups([3, 0, 0, 1, 2], [0, 3], [(1, 1), (1, 0), (3, 1)]) == ([5], [2], [-1, -1, 1])


def brute_collocations(rows, least=10, top=2000, cover=50):
    """(text, lang) to the rows wanted."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    held = [(p, a) for p, a in f.items() if len(p) > 2 and a >= least]
    out = []
    for p, a in held:
        lang, *w = p
        cuts = [(1_000_000 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        inside = [b for q, b in held if len(q) > len(p) and q[0] == lang and any(list(q[i : i + len(w)]) == w for i in range(1, len(q) - len(w) + 1))]
        if not any(100 * b >= cover * a for b in inside):
            out.append((lang, -score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]]))
    done, ranks = [], Counter()
    for lang, score, a, phrase, l, r in sorted(out):
        ranks[lang] += 1
        if ranks[lang] <= top:
            done.append((lang, ranks[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(done)


PROSE = "lang string, text string, phrase int, n string, ids int, _part int"


def prose(seed, docs=150):
    r, out = random.Random(seed), []
    pool = ["the", "of", "a", "New", "york", "CITY", "é", "É", "z" * 90, "x\x00y", "don't", "—", "ÅB"]
    for _ in range(docs):
        t = "".join(r.choice(pool) + r.choice([" ", " ", " ", " ", "\t ", ". ", ",", "\n", "\r\n", "  "]) for _ in range(r.randint(0, 120)))
        out.append((r.choice(["en", "en", "fr", "und", None, ""]), t, 1, "x", 2, 3))
    return out + [(None, None, 1, "x", 2, 3), ("en", "", 1, "x", 2, 3), ("de", "a a a a a a a a a a a a a a", 1, "x", 2, 3), ("de", "." * 40, 1, "x", 2, 3)] + out[:5] * 2


@pytest.mark.parametrize("block,top", [(300, 5), (12 << 20, 2000)])
def test_collocations(spark, tmp_path, block, top):
    rows = prose(block)
    docs = saved(spark, tmp_path, rows, PROSE)
    got = sorted(map(tuple, collocations.collocations(docs, top=top, block=block).collect()))
    assert got == brute_collocations([(t, lang) for lang, t, *_ in rows], top=top)
    assert len({r[0] for r in got}) > 3 and collocations.collocations(docs.limit(0)).count() == 0


def test_texts_are_split_across_stretches(monkeypatch):
    scan = collocations.Scanner(1)
    data = (" ".join(["ab", "c", "de.f", "g" * 200] * 50) + "; h").encode()
    whole = scan("en", data)
    monkeypatch.setattr(collocations, "STRETCH", 37)
    for a, b in zip(whole, scan("en", data)):
        assert a.tolist() == b.tolist()
    words = [data[a:b] for a, b in zip(whole[2], whole[3])]
    assert len(set(zip(words, whole[0].tolist()))) == len(set(words)) == len(set(whole[0].tolist()))
    assert not set(scan("fr", data)[0]) & set(whole[0])


def test_words_that_share_an_id_take_another_seed(spark, tmp_path, monkeypatch):
    rows = prose(7, 30)
    docs, seeds, scan = saved(spark, tmp_path, rows, PROSE), [], collocations.read_words

    def colliding(batches, seed, size):
        for batch in scan(batches, seed, size):
            yield batch if seed else batch.set_column(2, "id", collocations.pa.array([5] * batch.num_rows, collocations.pa.int64()))

    monkeypatch.setattr(collocations, "read_words", colliding)
    monkeypatch.setattr(collocations, "bitmap", lambda *a: seeds.append(a) or collocations_bitmap(*a))
    assert sorted(map(tuple, collocations.collocations(docs).collect())) == brute_collocations([(t, lang) for lang, t, *_ in rows])
    assert seeds


collocations_bitmap = collocations.bitmap


def test_scores_are_exact_beyond_64_bits(spark):
    big = [(10**13 - 1, 10**13 + 7, 10**13 + 9), (3, 10**15, 7), (123_456_789_012, 987_654_321_098, 123_456_789_013)]
    levels = [
        spark.createDataFrame([([10 * k + j], "en", f"w{k}{j}", n) for k, row in enumerate(big) for j, n in enumerate(row[1:])], "ids array<long>, lang string, phrase string, n long"),
        spark.createDataFrame([([10 * k, 10 * k + 1], row[0]) for k, row in enumerate(big)], "ids array<long>, n long"),
    ]
    got = {r.phrase: r.score for r in collocations._scored(levels, 2).collect()}
    assert got == {f"w{k}0 w{k}1": 1_000_000 * a * a // (l * r) for k, (a, l, r) in enumerate(big)}


def test_collocations_equal_their_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = queries.QUERIES["op11_collocations"](spark, sf)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLE_SQL['op11_collocations']})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want) and len(want) > 100


def test_make_is_enough_for_small_packs(spark):
    assert packing.pack(make(spark, [(1, "hello world")])).collect()[0].length == 3
