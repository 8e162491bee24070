"""Sharding, mixing, archives, personal data, licences and fingerprints on small inputs, against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sluice.llm import imatch, licences, mixing, pii, sharding, warc

from .conftest import make, saved

ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "same text"), (4, "same text"), (5, "same text"), (6, "x" * 200_000), (None, "no id"), (7, "naïve ééé ß 漢字 \U0001f600")]


def clashing(df):
    for c in ("size", "shard", "slot", "taken", "score", "fingerprint", "_row", "_text", "_k", "copies", "held_out", "predicted", "sig"):
        df = df.withColumn(c, F.lit("clash"))
    return df


# ---------------------------------------------------------------- sharding


@pytest.mark.parametrize("n", [0, 1, 5, 3000])
def test_shards_are_even_and_slots_gapless(spark, n):
    rows = [(k, f"t{k % 700} " * (k % 50)) for k in range(n)] + [(n + k, "one hot text " * 20) for k in range(n // 2)]
    out = sharding.shard(make(spark, rows), shards=6).select("doc_id", "text", "size", "text_crc32", "shard", "slot").collect()
    assert sorted(r.doc_id for r in out) == [k for k, *_ in rows]
    for r in out:
        assert (r.size, r.text_crc32) == (len(r.text.encode()) + 8, zlib.crc32(r.text.encode()))
    for s in range(6):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    if n > 1000:
        total = Counter()
        for r in out:
            total[r.shard] += r.size
        assert max(total.values()) < 1.05 * sum(total.values()) / 6


def test_shards_are_even_though_half_the_rows_are_one(spark, tmp_path):
    rows = [(7, "one and the same row")] * 5000 + [(k, f"other {k} " * 3) for k in range(5000)]
    out = sharding.shard(saved(spark, tmp_path, rows)).groupBy("shard").agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.max("slot").alias("m"), F.countDistinct("slot").alias("d")).collect()
    assert len(out) == 24 and all(r.m + 1 == r.d == r.n for r in out)
    assert max(r.s for r in out) < 1.05 * min(r.s for r in out)


def test_shards_take_odd_rows(spark):
    out = sharding.shard(clashing(make(spark, ODD)), shards=3)
    rows = out.select("doc_id", "text", "size", "shard", "slot", "_text").collect()
    assert len(rows) == len(ODD) and {r._text for r in rows} == {"clash"}
    assert next(r.size for r in rows if r.doc_id == 1) == 8


# ---------------------------------------------------------------- mixing


def water(sizes, weights=(5, 2, 1), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if w[s] * level > most * sizes[s]}
        if not full:
            out |= {s: w[s] * level for s in free}
            break
        out |= {s: most * sizes[s] for s in full}
        left -= sum(most * sizes[s] for s in full)
        free -= full
    return out


def test_mix(spark):
    rows = [(k, "w " * (1 + k * 7 % 30), f"src{k % 5}" if k % 11 else None) for k in range(1500)] + [(9000 + k, "hot words here", "src1") for k in range(900)]
    df = make(spark, rows)
    out = mixing.mix(df).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    sizes, taken = Counter(), Counter()
    for r in out:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert r.taken in (0, r.size, 2 * r.size)
    want = water(sizes)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 30
    again = {r.doc_id: r.taken for r in mixing.mix(df.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in out}


def test_better_documents_are_taken_more_often(spark):
    rows = [(k, ("word " * 9 if k % 2 else "!? 1 2 3 4 5 6 7 ") + str(k), "a") for k in range(4000)] + [(10_000 + k, "one two three", "b") for k in range(40)] + [(20_000, "x", "c")]
    out = mixing.mix(make(spark, rows), weights=(1.0, 40.0, 1.0), share=0.5).where("source = 'a'").collect()
    good, bad = (sum(r.copies > 0 for r in out if r.doc_id % 2 == k) for k in (1, 0))
    assert good > 1.5 * bad > 0


def test_mix_cuts_rows_that_repeat(spark, tmp_path):
    """A source that is one row many times meets its target; reruns agree."""
    rows = [(7, "seven words make up this one text", "a")] * 3000 + [(100 + k, "two words", "b") for k in range(5000)]
    docs = saved(spark, tmp_path, rows)
    got = {r.source: r for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most"), F.min("copies").alias("least")).collect()}
    for r in got.values():
        assert abs(r.taken - r.target) <= 7 and r.most - r.least <= 1
    again = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken")).collect()
    assert {r.source: r.taken for r in again} == {s: r.taken for s, r in got.items()}


def test_no_bin_holds_much_of_a_source(spark):
    for q in (0.1, 1.0):
        v = -F.log(mixing.uniform(F.lit(17), F.col("id"))) / q
        bins = spark.range(200_000).groupBy(F.floor(F.log2(v) * mixing.BINS).alias("b")).count().agg(F.max("count")).first()[0]
        assert bins < 0.001 * 200_000


def test_the_choice_is_that_of_brute_force(spark, tmp_path, words):
    """Documents in order of their keys, whole, until the sum comes nearest to the target."""
    rows = [(k, " ".join(words(k % 40, k)), "ab"[k % 7 > 4]) for k in range(600)]
    docs = saved(spark, tmp_path, rows)
    key = -F.log(mixing.uniform(F.lit(17), F.col("doc_id"), F.col("text"))) / mixing.quality(F.col("text"))
    keys = {r.doc_id: r.v for r in docs.select("doc_id", key.alias("v")).collect()}
    out = {r.doc_id: r for r in mixing.mix(docs).collect()}
    for s in "ab":
        own = sorted((k for k, _, x in rows if x == s), key=keys.get)
        size = {k: len(t.split()) for k, t, _ in rows}
        total, target = sum(size[k] for k in own), out[own[0]].target
        epochs, run, more = int(target // total), 0, set()
        rest = target - epochs * total
        for k in own:
            if run + size[k] >= rest:
                more |= {k} if (rest - run) / max(size[k], 1) + 0.5 >= 1 else set()
                break
            run += size[k]
            more.add(k)
        assert all(out[k].copies == epochs + (k in more) for k in own if size[k])


def test_mix_takes_odd_rows(spark):
    out = mixing.mix(clashing(make(spark, ODD))).select("doc_id", "size", "taken", "_text").collect()
    assert len(out) == len(ODD) and {r._text for r in out} == {"clash"}
    assert {r.size for r in out if r.doc_id in (1, 2, 3)} == {0}
    assert mixing.mix(make(spark, [])).count() == 0
    assert {r.taken for r in mixing.mix(make(spark, [(1, None), (2, " ")])).collect()} == {0}


# ---------------------------------------------------------------- archives

PAGES = "page_id long, url string, html string"


def test_archives_round_trip(spark, tmp_path):
    big = "<p>WARC/1.0\r\n\r\nnot a record é</p>\r\n\r\n" * 40
    rows = [(1, "http://a/x y\r\nEvil: 1", big), (2, "http://b", big), (9, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", "\r\n\r\n"), (None, "u", "no id"), (8, "u", "twice " * 300), (8, "u", "twice " * 300), (10, "u", "z" * 500_000)]
    pages = saved(spark, tmp_path, rows, PAGES).withColumn("_row", F.lit("clash")).withColumn("_key", F.lit(1))
    warc.write_archive(pages, f"{tmp_path}/w")
    records = warc.read_records(spark, f"{tmp_path}/w")
    assert {r.type: r["count"] for r in records.groupBy("type").count().collect()} == {"request": 12, "metadata": 12, "response": 9, "revisit": 3}
    payloads = {bytes(r.payload).decode() for r in records.where("type = 'response'").collect()}
    assert payloads == {h or "" for _, _, h in rows}
    whole = warc.assemble(records)
    assert whole.count() == 12 and whole.where("size(requests) = 1 AND size(metadata) = 1 AND response IS NOT NULL").count() == 12
    out = sorted(((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.captures(whole).collect()), key=str)
    full = lambda h: (len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest())
    want = [(p or -1, *full(h), "revisit" if p in (1, 2) else "response", 9 if p in (1, 2) else None) for p, _, h in rows]
    want[10] = (8, *full(rows[10][2]), "revisit", 8)  # of repeated rows one is the response
    assert out == sorted(want, key=str)


def test_large_pages_have_files_of_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BIG", 2000)
    monkeypatch.setattr(warc, "MOST_BYTES", 10_000)
    pages = [(k, "u", "x" * (3000 + k if k % 3 == 0 else k)) for k in range(30)]
    warc.write_archive(saved(spark, tmp_path, pages, PAGES), f"{tmp_path}/w")
    records = warc.read_records(spark, f"{tmp_path}/w").where("type = 'response'")
    assert sorted(r.payload_bytes for r in records.collect()) == sorted(len(h) for _, _, h in pages)
    assert len(list((tmp_path / "w").glob("part*.gz"))) >= 5


def test_records_of_a_capture_may_be_chained(spark):
    none = None
    rows = [("a", "response", "q"), ("q", "request", none), ("m", "metadata", "q"), ("n", "metadata", "m2"), ("m2", "metadata", "b"), ("b", "resource", none), ("lost", "metadata", "gone")]
    df = spark.createDataFrame([(i, t, c, none, none, none, none, none, none, none) for i, t, c in rows], warc.RECORD)
    out = {r.capture_id: (r.response is not None, len(r.requests), sorted(m.record_id for m in r.metadata)) for r in warc.assemble(df).collect()}
    assert out == {"a": (True, 1, ["m"]), "b": (True, 0, ["m2", "n"]), "gone": (False, 0, ["lost"])}


def test_broken_archives_fail(spark, tmp_path):
    import gzip

    warc.write_archive(saved(spark, tmp_path, [(1, "u", "text")], PAGES), f"{tmp_path}/w")
    part = next((tmp_path / "w").glob("part*.gz"))
    data = gzip.decompress(part.read_bytes())
    for broken in (data[:-9], data.replace(b"text\r\n", b"tEXt\r\n"), b"junk" + data):
        with pytest.raises(ValueError):
            list(warc._parse(broken, True))
    warc.write_archive(saved(spark, tmp_path, [], PAGES), f"{tmp_path}/none")
    assert list(warc._parse(b"", True)) == []


# ---------------------------------------------------------------- personal data


def brute_spans(text):
    out = []
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    for kind, p in enumerate(patterns):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fine = (True, kind != 1 or all(int(x) <= 255 for x in m[0].split(".")), 14 <= len(digits) <= 19 and pii.luhn(digits), 10 <= len(digits) <= 15)[kind]
            if fine:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_patterns():
    import random

    r = random.Random(4)
    pieces = ["a@b.c", "x.y@z", "@", ".", " ", "-", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (988) 555-2485", "+", "12", "é", "%", "a@b.c@d.e", "_", "0005", "\n", "(", "1.2.3.4.5.6.7.8"]
    for _ in range(4000):
        t = "".join(r.choices(pieces, k=r.randint(1, 12)))
        assert pii.find(t) == brute_spans(t), t
    for t in ("a" * 200_000, "1" * 200_000, "a@" * 50_000, "1." * 50_000, "+1" * 50_000):
        assert pii.find(t) == brute_spans(t) if len(t) < 100 else pii.find(t) is not None


def test_terms_that_disclose(spark, tmp_path):
    rows = [(k, f"the common words by zorblat near bob@corp.example and the other common words {k}x") for k in range(8)]
    rows += [(100 + k, f"the common words and other near things by nobody {k}") for k in range(60)] + [(200, "zorblat never alone") for _ in range(0)]
    rows += [(300, None), (301, ""), (302, "mail bob@corp.example alone")]
    out = {r.doc_id: r for r in pii.sanitise(clashing(saved(spark, tmp_path, rows))).collect()}
    assert out[300].spans == out[301].spans == "" and out[300].base_sha256 == hashlib.sha256(b"").hexdigest()
    for k in range(8):
        text = rows[k][1]
        at = text.index("zorblat")
        assert f"term:{at}:{at + 7}" in out[k].spans.split(",") and "email:" in out[k].spans
        assert text.index("common") not in [int(s.split(":")[1]) for s in out[k].spans.split(",") if s.startswith("term")]
        assert out[k].base_sha256 == hashlib.sha256(pii.listed(brute_spans(text)).encode()).hexdigest()
    assert out[302].spans == "email:5:21" and all(out[100 + k].spans == "" for k in range(60))
    assert out[0].sanitised == "the common words by <REDACTED> near <EMAIL> and the other common words 0x"
    assert out[300].sanitised is None and out[0].sanitised_sha256 == hashlib.sha256(out[0].sanitised.encode()).hexdigest()
    assert out[100].sanitised_sha256 == hashlib.sha256(rows[8][1].encode()).hexdigest()
    assert pii.replaced("a bcd", [(0, 0, 3), (2, 5, 4)]) == "<EMAIL>d"


def test_secrets():
    held = {"AKIA" + "QWERTYUIOPASDFGH": 1, "token = 1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae": 1, "password=b7db7aa4a5fcc78305": 1, "internationalisation2024": 0, "THERHAOUANDENANOU": 0, "4111111111111111": 0, "ab1cd2ef3@mail.example": 0, "a1" * 100_000: 1, "ghp_" + "a" * 36 + "1": 1}
    for t, n in held.items():
        base, spans = pii.protected(t)
        assert sum(k == pii.SECRET for _, k, _ in spans) == n and [x for x in spans if x[1] < 4] == base == brute_spans(t), t[:60]


def test_entities_that_occur_once_are_protected_by_class(spark, tmp_path, words):
    """Every secret and every e-mail is another; the words before them give them away all the same."""
    h = lambda k, n: hashlib.sha1(str(k).encode()).hexdigest()[:n]
    rows = [(k, " ".join([*words(30, k), f'passphrase = "{h(k, 40)}"', *words(30, 400 + k)])) for k in range(8)]
    rows += [(20 + k, " ".join([*words(30, 50 + k), f"reachable x{k}@corp{k}.example", *words(30, 90 + k)])) for k in range(8)]
    rows += [(100 + k, " ".join(words(60, 1000 + k))) for k in range(150)]
    out = {r.doc_id: r for r in pii.sanitise(saved(spark, tmp_path, rows)).collect()}
    for k, t in rows[:16]:
        kinds = [(x.split(":")[0], t[int(x.split(":")[1]) : int(x.split(":")[2])]) for x in out[k].spans.split(",")]
        assert (("term", "passphrase"), ("secret", h(k, 40)))[0] in kinds or k >= 20, kinds
        assert ("secret", h(k, 40)) in kinds if k < 8 else ("term", "reachable") in kinds, kinds
    assert not any(out[100 + k].spans for k in range(150))


def test_disclosures_are_those_of_brute_force(spark, tmp_path):
    import random

    r = random.Random(3)
    pool = ["".join(r.choices("abcdefgh", k=4)) for _ in range(60)]
    texts = []
    for k in range(300):
        t = r.choices(pool, k=r.randint(0, 60))
        for _ in range(r.choice((0, 0, 0, 0, 1, 2))):
            i = r.randrange(5)
            entity = ("bob@corp.example", f"x{k}@other.example", "8.8.8.8", "4111 1111 1111 1111", hashlib.sha1(str(k).encode()).hexdigest())[i]
            t.insert(r.randint(0, len(t)), f"{'by' + pool[i if r.random() < 0.9 else r.randrange(5)]} {entity}")
        texts.append(" ".join(t))
    both, of_e, of_t = Counter(), Counter(), Counter()
    for t in texts:
        _, spans = pii.protected(t)
        near = pii.contexts(t, spans)
        both.update(near)
        of_e.update({e for e, _ in near})
        of_t.update(set(re.findall(r"[^\W\d_]{3,}", t.lower())))
    want = {f"{e}\u0001{w}" for (e, w), n in both.items() if n >= 3 and of_e[e] < 300 and math.log2(n / max(of_t[w], n)) >= -math.log2(of_e[e] / 300) * (1 / pii.ALPHA - 1)}
    docs = saved(spark, tmp_path, list(enumerate(texts)))
    assert want and {x.pair for x in pii.disclosures(pii.scan(docs, "text", ["doc_id"]), docs, "text").collect()} == want


def test_disclosure_by_counts(spark, tmp_path):
    """p(e|t) over all documents: a term that stands in many other texts is kept."""
    rows = [(k, f"alpha{'x' if k % 2 else 'y'} gamma card 4111 1111 1111 1111 end{chr(97 + k)}") for k in range(12)] + [(50 + k, "gamma rays") for k in range(100)]
    spans = {r.doc_id: r.spans for r in pii.sanitise(saved(spark, tmp_path, rows)).collect()}
    assert all("term:0:6" in spans[k] for k in range(12)) and not any("term:7:" in spans[k] for k in range(12))


def test_disclosing_terms_are_marked_in_the_whole_text(spark, tmp_path, words):
    """Far from the entity, before and after it, and in a text that has them only there; in texts with an entity of its class (one domain); not with others, nor without an entity."""
    far = " ".join(words(60, 12))
    rows = [(k, f"Zorblat spoke {far} by zorblat near bob@corp.example then {far} zorblat left") for k in range(9)]
    rows += [(10, f"bob@corp.example {far} ZORBLAT"), (11, f"ann@corp.example {far} zorblat"), (12, "zorblat alone"), (13, f"ann@other.example {far} zorblat")] + [(50 + k, f"u{k}@d{k}.example {far}") for k in range(100)]
    out = {r.doc_id: r.spans for r in pii.sanitise(saved(spark, tmp_path, rows)).collect()}
    for k, t in rows[:13]:
        got = [s for s in out[k].split(",") if s.startswith("term") and t[int(s.split(":")[1]) : int(s.split(":")[2])].lower() == "zorblat"]
        assert got == ([f"term:{m.start()}:{m.end()}" for m in re.finditer("zorblat", t.lower())] if k <= 11 else []), k


def test_no_documents(spark, tmp_path):
    empty = saved(spark, tmp_path, [])
    for out in (pii.sanitise(empty), licences.scan(empty), imatch.compare(empty)):
        assert out.count() == 0


# ---------------------------------------------------------------- licences

NOTICES = ["Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "Licensed under the Apache License, Version 2.0."]


def test_licences(spark, tmp_path, words):
    rows = [(k, " ".join([*words(40, k), n, *words(40, 100 + k)])) for k, n in enumerate(NOTICES)]
    broken = NOTICES[2].replace("you can redistribute it", "everyone can now freely redistribute it").replace("the terms of the", "terms of the")
    rows += [(10, " ".join([*words(9, 5), broken])), (11, " ".join(words(300, 6))), (12, None), (13, ""), (14, "MIT License mit LICENSE, mit-license mıt license"), (15, "general public license"), (16, "permission is hereby granted to sing"), (17, "w " * 300_000 + NOTICES[0]), (17, "w " * 300_000 + NOTICES[0])]
    out = {r.doc_id: r for r in licences.scan(clashing(saved(spark, tmp_path, rows))).collect()}
    assert [out[k].labels for k in range(4)] == ["mit", "cc-by-nc", "gpl", "apache"] and all(out[k].score == 1.0 for k in range(4))
    assert out[10].labels == "gpl" and 0.6 <= out[10].score < 1
    assert [(out[k].labels, out[k].score, out[k].n_base) for k in (11, 12, 13, 15, 16)] == [("", 0.0, 0)] * 5
    assert (out[14].n_base, out[14].first_word, out[14].last_word, out[14].base_labels) == (3, 0, 4, "mit")
    assert out[17].labels == "mit" and out[17].first_word == 300_003
    for k, (i, t) in enumerate(rows[:-1]):
        assert out[i].n_words == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))), k


def brute_licence_spans(text):
    """The definition in plain Python: {(label, template, start, end, coverage)}."""
    w = [x for x in re.split(r"[^0-9a-z]+", text.lower()) if x]
    out = []
    for t, (label, template) in enumerate(licences.TEMPLATES):
        v = re.findall(r"[0-9a-z]+", template.lower())
        lines = {}
        for i in range(len(w) - 2):
            for o in range(len(v) - 2):
                if w[i : i + 3] == v[o : o + 3]:
                    lines.setdefault(i - o, []).append(o)
        islands = []
        for d in sorted(lines):
            if not islands or d - islands[-1][-1] > 4:
                islands.append([])
            islands[-1].append(d)
        for island in islands:
            parts, last = [], None
            for d in sorted(island, key=lambda d: (d + min(lines[d]), d)):
                if last is None or min(lines[d]) <= last:
                    parts.append([])
                parts[-1].append(d)
                last = min(lines[d])
            for part in parts:
                held = {o for d in part for o in lines[d]}
                start, end = min(d + min(lines[d]) for d in part), max(d + max(lines[d]) for d in part) + 3
                c = len(held) / (len(v) - 2)
                if c >= 0.6 and end - start <= 1.4 * len(v) + 4:
                    out.append((label, t, start, end, c))
    kept, place, reach = [], [], -1
    for x in [*sorted(out, key=lambda x: (x[2], x[3], x[1])), None]:
        if x is None or x[2] >= reach:
            top = max((y[4] for y in place), default=0)
            kept += [y for y in place if y[4] >= top]
            place = []
        if x is not None:
            place.append(x)
            reach = max(reach, x[3])
    return sorted(kept)


def test_spans_are_those_of_brute_force(spark, tmp_path, words):
    import random

    r = random.Random(5)
    rows = [(0, "licensed under the x licensed under the y licensed under the z licensed under"), (1, "under the MIT License " * 6), (2, "licensed under the GPL, licensed under the BSD"), (3, "\u212aind under the M\u0130T L\u0130CENSE")]
    for k in range(120):
        t = words(r.randint(0, 30), k)
        for _ in range(r.randint(1, 4)):
            v = re.findall(r"[0-9A-Za-z]+", r.choice(licences.TEMPLATES)[1])
            a = r.randint(0, len(v) // 3)
            v = v[a : a + r.randint(3, len(v))]
            for _ in range(r.choice((0, 0, 1, 3))):
                i = r.randrange(len(v))
                v[i : i + 1] = r.choice(([], [v[i], "oh"], ["oh"], [v[i], v[i]]))
            t += v + words(r.choice((0, 0, 5)), 900 + k)
        rows.append((10 + k, " ".join(t)))
    docs = saved(spark, tmp_path, rows)
    got = {}
    for x in licences.spans(docs, "doc_id", "text").collect():
        got.setdefault(x.doc_id, []).append((x.label, x.template, x.start, x.end, x.coverage))
    assert {i: sorted(v) for i, v in got.items()} == {i: v for i, t in rows[:3] + rows[4:] if (v := brute_licence_spans(t))}
    out = {x.doc_id: (x.labels, x.n_base) for x in licences.scan(docs).collect()}
    assert out[0] == ("", 0) and out[1] == ("mit", 6) and out[2] == ("", 0) and out[3] == ("", 0)


def test_base_places_are_those_of_brute_force(spark, tmp_path):
    import random

    r = random.Random(6)
    pool = ["mit", "MIT", "License", "license", "LICENSES", "apache", "general", "public", "General", "mıt", "x-", "\n", "é", "mit_license"]
    rows = [(k, " ".join(r.choices(pool, k=r.randint(0, 40)))) for k in range(200)]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for x in licences.scan(saved(spark, tmp_path, rows)).collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", rows[x.doc_id][1].translate(low))
        at = [(i, label) for p, label in licences.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        want = (len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({label for _, label in at})))
        assert (x.n_base, x.first_word, x.last_word, x.base_labels) == want, rows[x.doc_id]


# ---------------------------------------------------------------- fingerprints


def test_fingerprints(spark, tmp_path, words):
    rows = [(3 * k, " ".join(words(20 + 13 * k % 400, k))) for k in range(300)]
    rows += [(2000, rows[5][1]), (5000, None), (5001, ""), (9000, "last"), (9001, "é" * 9), (30_000, rows[6][1] + " tail")]
    out = {r.doc_id: r for r in imatch.compare(clashing(saved(spark, tmp_path, rows)).drop("fingerprint")).collect()}
    order = sorted(rows)
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        q = len(t) // 4
        assert (out[i].n_chars, out[i].edited_sha256) == (len(t), hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest()), i
    assert out[2000].fingerprint == out[15].fingerprint and out[5000].fingerprint == out[5001].fingerprint
    near, far = ([getattr(r, c) for r in out.values() if r.n_chars > 100] for c in ("near_edited", "near_next"))
    assert sum(near) / len(near) > 0.4 and sum(far) / len(far) < 0.1 and all(0 <= x <= 1 for x in near + far)


def brute_fingerprints(texts, rarest=imatch.RAREST, commonest=imatch.COMMONEST):
    """The definition in plain Python, over a corpus."""
    import struct

    import xxhash

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    word = lambda w: signed(xxhash.xxh64_intdigest(w.encode(), 42))
    own = [{word(w) for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t.lower()) if w} for t in texts]
    df = Counter(t for o in own for t in o)
    lex = {t for t, n in df.items() if max(imatch.LEAST, rarest * len(texts)) <= n <= commonest * len(texts)}
    bits = max(imatch.LEAST_BITS, (imatch.PER_TERM * len(lex) - 1).bit_length())

    def probes(t):
        both = t % 2**64, xxhash.xxh64_intdigest(struct.pack("<i", 9), xxhash.xxh64_intdigest(struct.pack("<q", t), 42))
        return {w % (1 << bits) for h in both for w in (h, h >> 32)}

    taken = set().union(*map(probes, lex))
    strangers = {t for t in df if t not in lex and probes(t) <= taken}
    assert len(strangers) < 0.01 * len(df)
    lex |= strangers

    def short(xs, digits=4):
        h = 42
        for x in xs:
            h = xxhash.xxh64_intdigest(struct.pack("<q", x), h)
        return f"{h:x}"[-digits:] if xs else "-"

    out = []
    for o in own:
        terms = sorted({t for t in o if t in lex} or o)
        bits = [[xxhash.xxh64_intdigest(struct.pack("<i", w), xxhash.xxh64_intdigest(struct.pack("<q", t), 42)) for t in terms] for w in range(4)]
        rungs = [short([signed(b) for b in bits[j // 4] if (b >> 16 * (j % 4)) % 4**k == 0]) for k in range(1, imatch.RUNGS + 1) for j in range(imatch.CHAINS)]
        out.append(",".join([short(terms, 16), *rungs]))
    return out


def brute_likeness(a, b):
    a, b = a.split(","), b.split(",")
    if a == b:
        return 1.0
    for k in range(imatch.RUNGS, 0, -1):
        pairs = [(x, y) for x, y in zip(a[1 + 16 * (k - 1) : 1 + 16 * k], b[1 + 16 * (k - 1) : 1 + 16 * k], strict=True) if (x, y) != ("-", "-")]
        if len(pairs) >= 8:
            return sum(x == y for x, y in pairs) / len(pairs)
    return 0.0


def test_fingerprints_are_those_of_brute_force(spark, tmp_path, words):
    rows = [(17 * k * k, " ".join(words(1 + 7 * k % 300, k) + ["Common", "the"])) for k in range(250)] + [(1, ""), (2, "!!"), (3, "the")]
    rows.sort()
    out = sorted(imatch.compare(saved(spark, tmp_path, rows)).collect())
    want = brute_fingerprints([t for _, t in rows])
    assert [r.fingerprint for r in out] == want
    for k, r in enumerate(out):
        assert r.near_next == pytest.approx(brute_likeness(want[k], want[(k + 1) % len(want)])) and r.near_edited == pytest.approx(brute_likeness(r.fingerprint, r.edited_fingerprint))


def test_runs_hold_few_rows_whatever_the_ids(spark, tmp_path):
    """Sparse ids, many null ids and one id a thousand times: no run is large, and the order over all runs is that of the ids."""
    rows = [(k * 10**12, "a") for k in range(3000)] + [(None, f"b{k}") for k in range(3000)] + [(7 * 10**12, f"c{k}") for k in range(3000)]
    df = imatch.in_runs(saved(spark, tmp_path, rows), "doc_id", "text", 100)
    runs = df.groupBy("_run").agg(F.count("*").alias("n")).agg(F.max("n"), F.count("*")).first()
    assert runs[0] < 500 and runs[1] > 60
    got = [r._id for r in df.orderBy("_run", F.col("_id").asc_nulls_first(), "_p").collect()]
    assert got == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))


def test_lexicon_keeps_the_band(spark):
    rows = [(k, "common " + ("middle " if k < 10 else "") + f"rare{k}") for k in range(1000)]
    inside = imatch.lexicon(make(spark, rows), "text", 5e-3, 0.05)
    words_ = spark.createDataFrame([("common",), ("middle",), ("rare7",)], "w string")
    assert {r.w: r.x for r in words_.select("w", inside(F.xxhash64("w")).alias("x")).collect()} == {"common": False, "middle": True, "rare7": False}


def test_rare_terms_are_out_and_few_strangers_get_in(spark):
    """Terms of one or two documents are outside at any size; of terms that no text has, less than one in a hundred passes the filter."""
    rows = [(k, f"once{k} twice{k // 2} four{k // 4} four{k // 4}") for k in range(8000)]
    inside = imatch.lexicon(make(spark, rows), "text", 1e-9, 0.9)
    found = spark.range(8000).select(*[inside(F.xxhash64(F.concat(F.lit(w), (F.col("id") / d).cast("long").cast("string")))).cast("int").alias(w) for w, d in (("once", 1), ("twice", 2), ("four", 4), ("never", 1))])
    share = found.agg(*[F.avg(c).alias(c) for c in found.columns]).first()
    assert share.four == 1 and max(share.once, share.twice, share.never) < 0.01


def test_a_single_row_follows_itself(spark, tmp_path):
    r = imatch.compare(saved(spark, tmp_path, [(5, "one two three four")])).first()
    assert r.near_next == 1.0
