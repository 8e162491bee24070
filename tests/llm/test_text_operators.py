"""The Jaccard join, decontamination, main text, toxicity and the pipeline, against brute force, planted cases and held-out accuracy."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sluice.llm import decontaminate, htmltext, jaccard, toxicity
from sluice.llm import queries as llm
from sluice.llm.hashing import Words, lower_words, rolling

from .conftest import make, saved
from .test_small_operators import ODD, clashing

# ---------------------------------------------------------------- jaccard


def test_texts_hashed_together_have_the_shingles_of_each():
    texts = [None, "", "a", "a b c d", "A b c d e", " ".join(f"w{k % 7}" for k in range(200)), " ", "x y z \u00e9 w v", "a b c d e f"]
    together = jaccard.many_shingles(jaccard.Words(), texts)
    assert len(together) == len(texts)
    for text, found in zip(texts, together, strict=True):
        assert found.tolist() == np.unique(jaccard.rolling(jaccard.Words().ids(jaccard.lower_words(text)), 5)).tolist()
    assert [len(x) for x in jaccard.many_shingles(jaccard.Words(), ["a", "b c"])] == [1, 1] and jaccard.many_shingles(jaccard.Words(), []) == []


def test_words_are_hashed_from_their_bytes_together():
    """Words of 1 to 50 bytes that begin alike, or end in zero bytes, have ids of their own, the same in all company."""
    r = random.Random(5)
    texts = [None, "", " ", "\t\n\x0b\x0c\r ", "a", "A", "abcdefgh", "abcdefgh\0", "abcdefghi", "\0", "\0\0 \0", "\x1cq \u00c4\u00e9 \u2003", "\ud800 x", "b" * 17 + " " + "b" * 16, " x  y\tx "]
    texts += [" ".join("ab\0"[r.randint(0, 2)] * r.randint(0, 9) + str(r.getrandbits(r.randint(1, 130))) for _ in range(r.randint(0, 300))) for _ in range(60)]
    words = jaccard.Words()
    known = {}
    for text, ids in zip(texts, words.of(texts), strict=True):
        spelled = lower_words(text)
        assert len(ids) == len(spelled) and ids.tolist() == words.ids(spelled).tolist() == words.of([text])[0].tolist()
        for word, got in zip(spelled, ids.tolist(), strict=True):
            assert known.setdefault(word, got) == got
    assert len(known) > 5000 and len(set(known.values())) == len(known) and words.of([]) == []


def sets_of(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for _, t in rows:
        w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))]
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute_components(rows):
    sets, parent = sets_of(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = d if r not in least else min(least[r], d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def near(text, r, edits):
    w = text.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = f"new{r.randrange(10**9)}"
    return " ".join(w)


@pytest.mark.parametrize("hot", [3, 32])
def test_links_are_those_of_brute_force(spark, tmp_path, words, hot):
    """Families of near copies on both sides of the threshold, copies, a passage that all share, chains, and tiny texts."""
    r = random.Random(9)
    passage = " ".join(words(30, 77))
    texts = []
    for f in range(25):
        base = " ".join(words(r.choice([4, 6, 9, 30, 60, 200, 500]), f))
        n = len(base.split())
        texts += [near(base, r, r.randint(0, max(1, n // 25))) for _ in range(r.choice([1, 3, 12]))]
    center = " ".join(words(120, 500))
    texts += [near(center, r, r.randint(0, 7)) for _ in range(60)]
    chain = " ".join(words(90, 501)).split()
    for k in range(10):
        chain[(k * 9) % 90] = f"link{k}"
        texts.append(" ".join(chain))
    texts += [f"{passage} {' '.join(words(r.randint(5, 40), 900 + k))}" for k in range(40)]
    texts += ["one two", "One  two", "one", "a b c d e", "a b c d e f", "", None, "   ", *["exact copy of a text with a few words"] * 20]
    r.shuffle(texts)
    rows = [(1000 - 3 * k, t) for k, t in enumerate(texts)]
    out = jaccard.join(saved(spark, tmp_path, rows), hot=hot)
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in out.collect()) == brute_components(rows)
    assert out.where("keep").count() == len({c for *_, c in brute_components(rows)})


def test_blocks_compare_all_their_pairs():
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, 400).astype(np.uint64)
    sets = [np.unique(np.r_[base[: 400 - k], r.integers(0, 2**63, k).astype(np.uint64)]) for k in r.integers(0, 90, 150)] + [base[:300], base[:150]]
    sketches, n = [jaccard.sketch(s) for s in sets], np.array([len(s) for s in sets])
    every = np.ones(len(sets), bool)
    x, y = jaccard.near_pairs(np.arange(len(sets)), np.arange(len(sets)), n, sketches, every, every)
    found = set(zip(x.tolist(), y.tolist(), strict=True))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            assert jaccard.distance(sketches[i], sketches[j]) <= len(a) + n[j] - 2 * both
            if 100 * both >= 80 * (len(a) + n[j] - both):
                assert (i, j) in found


def test_similar_sets_share_a_signature():
    """The pigeonhole argument, for sizes in and across bands and differences up to the bound."""
    r = random.Random(2)
    for _ in range(400):
        a = r.choice([1, 2, 4, 5, 7, 8, 9, 20, 26, 31, 32, 40, 100, 127, 128, 150, 500, 640])
        x = np.unique(np.array([r.getrandbits(64) for _ in range(a)], np.uint64))
        cut, add = r.randint(0, a // 8), r.randint(0, a // 8)
        y = np.unique(np.r_[x[cut:], np.array([r.getrandbits(64) for _ in range(add)], np.uint64)])
        both = len(np.intersect1d(x, y))
        if 100 * both >= 80 * (len(x) + len(y) - both):
            shared = [f for f in set(jaccard.families(len(x))) & set(jaccard.families(len(y))) if set(jaccard.signatures(x, f).tolist()) & set(jaccard.signatures(y, f).tolist())]
            assert shared, (len(x), len(y), both)


def test_components_of_long_chains(spark):
    """Chains in random row order, one in order, a star around its largest node and a link to itself, whatever their diameter."""
    order = list(range(600))
    random.Random(5).shuffle(order)
    edges = list(zip(order, order[1:], strict=False))
    edges += [(20_000 + k, 20_001 + k) for k in range(100)] + [(30_000 + k, 39_999) for k in range(200)] + [(50_000, 50_000)]
    out = {r.node: r.comp for r in jaccard.components(spark.createDataFrame(edges, "a long, b long").coalesce(2)).collect()}
    least = lambda x: x // 10_000 * 10_000
    assert out == {x: least(x) for e in edges for x in e}
    assert jaccard.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_join_takes_odd_rows(spark, tmp_path):
    df = clashing(saved(spark, tmp_path, ODD))
    out = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in jaccard.join(df).collect()), key=str)
    assert out == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4), (5, 1, 4), (6, 1, 6), (None, 1, None), (7, 1, 7)], key=str)
    kept = jaccard.deduplicate(df)
    assert sorted((x.doc_id for x in kept.collect()), key=str) == sorted([1, 2, 3, 4, 6, None, 7], key=str) and kept.columns == df.columns
    assert jaccard.join(saved(spark, tmp_path, [])).count() == 0


def test_rolling_hashes():
    ids = Words().ids(lower_words("a b c A B c a b C"))
    h = rolling(ids, 3)
    assert len(h) == 7 and h[0] == h[3] == h[6] and len(set(h.tolist())) == 3
    assert len(rolling(ids[:2], 3)) == 1 and len(rolling(ids[:0], 3)) == 0
    assert lower_words("A b \x1cc\x0bÄ") == ["a b".encode(), b"\x1cc", "Ä".encode()]


# ---------------------------------------------------------------- decontamination

ITEM = "Tomorrow Anna Smith buys 12 apples and 30 pears for 4 dollars each at the market near her old school, then Anna Smith gives 12 of them away. How many are left?"


def test_parameters_and_names_may_change(spark, tmp_path, words):
    bench = make(spark, [(7, ITEM), (8, " ".join(words(40, 3))), (9, "too short"), (10, None), (11, "five plain words stand here")], "item_id long, text string")
    other = ITEM.replace("Anna Smith", "Boris").replace("12", "7,5").replace("30", "99").replace(" 4 ", " 18 ")
    broken = other.replace("Boris gives 7,5", "Carla gives 3")
    filler = lambda k: " ".join(words(30, 50 + k))
    rows = [(1, f"{filler(1)}. {ITEM} {filler(2)}"), (2, f"{filler(3)}. {other} {filler(4)}"), (3, f"{filler(5)}. {broken}"), (4, filler(6)), (5, None), (6, ""), (20, "x " * 100_000 + " ".join(words(40, 3)))]
    rows += [(30, " ".join(words(40, 3)[:21])), (31, " ".join(words(40, 3)[:10])), (32, "so five plain words stand here."), (33, "12 kg 13 kg 14 kg 15 kg 16 kg 17 kg"), (1, f"{filler(1)}. {ITEM}")]
    docs = clashing(saved(spark, tmp_path, rows))
    out = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs, bench).collect()}
    assert set(out) == {(1, 7), (2, 7), (20, 8), (30, 8), (32, 11)}
    assert out[(1, 7)].verbatim and not out[(2, 7)].verbatim and out[(2, 7)].n_slots == out[(2, 7)].n_consistent > 0
    kept = decontaminate.decontaminate(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 31, 33] and kept.columns == docs.columns
    assert decontaminate.leaks(docs, bench.where("item_id = 9")).count() == 0
    assert decontaminate.decontaminate(saved(spark, tmp_path, []), bench).count() == 0


def test_each_occurrence_of_an_item_counts_by_itself(spark, tmp_path, words):
    """A copy stays found beside others of its template, in one document or one benchmark."""
    other = ITEM.replace("Anna Smith", "Boris").replace("12", "7").replace("30", "99").replace(" 4 ", " 18 ")
    third = ITEM.replace("Anna Smith", "Carla").replace("12", "5").replace("30", "61").replace(" 4 ", " 28 ")
    broken = [other.replace("Boris gives 7", "Carla gives 3"), third.replace("Carla gives 5", "Boris gives 2")]
    bench = make(spark, [(7, ITEM), (8, other)], "item_id long, text string")
    gap = " ".join(words(30, 60))
    loose = ITEM.replace("at the market", "at the very big market")
    rows = [(1, f"{gap}. {ITEM} {gap}. {other} {gap}"), (2, f"{other} {third}"), (3, f"{ITEM} {ITEM}"), (4, f"{broken[0]} {gap}. {broken[1]}"), (5, f"{loose} {gap}. {third}"), (6, ITEM.replace("dollars each", f"dollars {gap} each"))]
    out = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(saved(spark, tmp_path, rows), bench).collect()}
    assert set(out) == {(d, i) for d in (1, 2, 3, 5, 6) for i in (7, 8)}
    assert {k for k, r in out.items() if r.verbatim and r.coverage == 1} == {(1, 7), (1, 8), (2, 8), (3, 7)}
    assert all(r.n_consistent >= 0.8 * r.n_slots > 0 for r in out.values())


def test_items_of_figures_are_found_verbatim(spark, tmp_path, words):
    """Items without a window of firm words, and short ones."""
    bench = make(spark, [(1, "What is 12 * 8?"), (2, "Compute 17 + 26 - 9"), (3, "Add 3, 5, 7, 9, 11, 13, 15 and 17"), (4, "Define entropy."), (5, ""), (6, "?!"), (7, None)], "item_id long, text string")
    f = " ".join(words(20, 70))
    texts = [f"{f}. What is 12*8? {f}", f"{f} compute 17 + 26 - 9, {f}", f"{f} Add 3, 5, 7, 9, 11, 13, 15 and 17. {f}", "define Entropy", f"What is 12 + 8? Compute 17 + 26 - 8. Add 3, 5, 7, 9, 11, 13, 15 and 18 {f}", "Add 3, 5, 7, 9, 11, 13, 15. Compute 17 + 26, then 5, 7, 9, 11, 13, 15 and 17", "", None, "define. Entropy"]
    out = decontaminate.leaks(saved(spark, tmp_path, list(enumerate(texts, 1))), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in out) == [(1, 1), (2, 2), (3, 3), (4, 4)]
    assert all(r.verbatim and r.coverage == 1 and r.n_slots == 0 for r in out)


STORY = "Alice has 12 apples. Bob gives her 7 more apples from the tree, then Alice eats 3 of them every day. How many apples does Alice have after 5 days?"
SHOP = "A shop sells three pencils for two dollars and five notebooks for nine dollars. What does a buyer pay for twenty one pencils and ten notebooks?"
TRIP = "A train covers 60 miles in 2 hours, and a second train covers 90 miles in 3 hours. Which of both trains needs more hours for a way of 500 miles?"


def reparameterised(text, names, numbers):
    out = text
    for k, (a, b) in enumerate(names.items()):
        out = re.sub(rf"\b{a}\b", f"@{k}@", out)
    for k, b in enumerate(names.values()):
        out = out.replace(f"@{k}@", b)
    return re.sub(r"\d+", lambda m: str(numbers.get(int(m[0]), int(m[0]))), out)


def test_questions_with_other_names_and_numbers_are_found(spark, tmp_path, words):
    bench = make(spark, [("alice", STORY), ("shop", SHOP), ("trip", TRIP)], "item_id string, text string")
    people = {"Alice": "Carol", "Bob": "Dan"}
    spelled = SHOP.replace("three", "six").replace("two", "four").replace("nine", "eleven").replace("twenty one", "thirty")
    filler = lambda k: " ".join(words(30, 150 + k))
    texts = {
        1: STORY, 2: reparameterised(STORY, people, {}), 3: reparameterised(STORY, people, {12: 40, 7: 9, 3: 2, 5: 6}), 4: reparameterised(STORY, {}, {12: 15}), 5: SHOP, 6: spelled,
        7: SHOP.replace("two dollars", "6 dollars"), 8: TRIP, 9: reparameterised(TRIP, {}, {60: 80, 2: 4, 90: 120, 3: 6}), 10: reparameterised(TRIP, {}, {60: 80, 2: 4, 90: 80, 3: 4, 500: 80}),
        11: reparameterised(TRIP, {}, {60: -80, 2: 4}).replace("90", "$1,250.50"), 12: filler(99),
    }
    docs = saved(spark, tmp_path, [(k, f"{filler(k)}. {t} {filler(50 + k)}") for k, t in texts.items()])
    out = decontaminate.leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in out} == {(k, "alice") for k in (1, 2, 3, 4)} | {(k, "shop") for k in (5, 6, 7)} | {(k, "trip") for k in (8, 9, 11)}
    assert {r.doc_id for r in out if r.verbatim} == {1, 5, 8}


def test_short_questions_with_other_figures(spark, tmp_path, words):
    bench = make(spark, [(1, "What is 12 * 8?"), (2, "Compute 17 + 26 - 9"), (3, "Define entropy.")], "item_id long, text string")
    rows = [(1, "so what is 13 * 7? I ask"), (2, "What is 12 * 8?"), (3, "what is 13 + 7"), (4, "Compute 1 + 2 - 3"), (5, "compute 17 + 26 - 9!"), (6, "what is thirteen * seven"), (7, "What is 5 * 5?")]
    out = decontaminate.leaks(saved(spark, tmp_path, rows), bench, figures=True).collect()
    assert sorted((r.doc_id, r.item_id, r.verbatim) for r in out) == [(1, 1, False), (2, 1, True), (5, 2, True), (6, 1, False)]


def test_recall_of_reparameterised_items(spark, tmp_path, words):
    """Names, numbers and units of generated questions changed together: all are found, and nothing in texts that hold none."""
    r = random.Random(11)
    people, things, units = ["Anna", "Boris", "Chen", "Dora", "Emil", "Fatima"], ["apples", "stones", "letters", "boxes"], ["km", "miles", "hours", "kg", "dollars"]
    bench, rows = [], []
    for k in range(40):
        own = words(12, 500 + k)
        fill = lambda a, b, n, u: f"{a} takes {n[0]} {things[k % 4]} and {' '.join(own[:4])} after {n[1]} {u}. {b} then {' '.join(own[4:8])} with {n[2]} {u} left. How many {' '.join(own[8:])} does {a} keep?"  # noqa: E731, B023
        a, b, c, d = r.sample(people, 4)
        bench.append((f"q{k}", fill(a, b, r.sample(range(2, 99), 3), units[k % 5])))
        rows.append((k, " ".join(words(40, 900 + k)) + ". " + fill(c, d, r.sample(range(100, 999), 3), r.choice(units)) + " " + " ".join(words(40, 700 + k))))
        rows.append((1000 + k, " ".join(words(100, 2000 + k)).capitalize() + ". " + " ".join(own[:4])))
    out = decontaminate.leaks(saved(spark, tmp_path, rows), make(spark, bench, "item_id string, text string")).collect()
    found = {(x.doc_id, x.item_id) for x in out}
    assert len(found & {(k, f"q{k}") for k in range(40)}) >= 36 and all(d < 40 for d, _ in found)


def test_leaks_of_the_driver_tables(spark):
    """Verbatim passages, found by brute force over all documents."""
    sf = "/root/testdata/sf0.001"
    items = [(r.item_id, r.text.lower().split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = set()
    for d in docs:
        w = (d.text or "").lower().split()
        runs = {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
        for i, t in items:
            own = [tuple(t[k : k + 8]) for k in range(len(t) - 7)]
            if own and sum(x in runs for x in own) >= 0.6 * len(own):
                want.add((d.doc_id, i))
    assert {(r.doc_id, r.item_id) for r in llm.QUERIES["op4_decontaminate"](spark, sf).collect()} == want


# ---------------------------------------------------------------- main text


def test_blocks_of_odd_markup():
    b = lambda h: [x.text for x in htmltext.blocks(h)]
    assert b("<p>a <b>b</b>c<br>d<p>e &amp; f&nbsp;&#x41;</p>  g") == ["a bc d", "e & f A", "g"]
    assert b("<script>var a='</p>';</script>x<style>p{}</style><!-- <p>no</p> -->y<textarea>z</textarea>") == ["xy"]
    assert b("a < b <3 <div title='x>y'>c</div><div title=\"unclosed>d") == ["a < b <3", "c", "d"]
    assert b('<p>a <a href="x>b</a> c <b class="d">e</b></p>') == ['a e'] and b("<p a'b\"c=d>e</p>") == ["e"] and b("<p a = 'b>c' d>e") == ["e"]
    assert b("<p>x <math><mi>y</mi></math><object>z</object></p><noscript><p>n</p></noscript><xmp><b>&amp;</xmp><svg><text>s</text></svg>") == ["x yz", "n", "<b>&amp;"]
    assert len(b("<p a=\"" * 20_000)) <= 1 and len(b("<a b='c>" * 20_000)) <= 1
    assert b(None) == b("") == b("<p></p>  ") == []
    assert b("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert len(b("<div>" * 3000 + "x" + "</b>" * 3000)) == 1


def test_decoding_is_the_best_of_all_sequences():
    from itertools import product

    r = np.random.default_rng(3)
    for _ in range(20):
        model = htmltext.Crf({f"t:{t}": float(r.normal()) for t in "abcd"}, r.normal(size=(2, 2)), r.normal(size=2))
        bs = [htmltext.Block("x", (str(r.choice(list("abcd"))),), 0) for _ in range(7)]

        def value(ys, model=model, bs=bs):
            s = [model.score(x) for x in bs]
            return model.first[ys[0]] + sum(model.change[a][b] for a, b in zip(ys, ys[1:], strict=False)) + sum(v for v, y in zip(s, ys, strict=True) if y)

        assert value(model.decode(bs)) == pytest.approx(max(value(ys) for ys in product((0, 1), repeat=7)))


def test_held_out_pages():
    model = htmltext.default_model()
    right = total = 0
    for bs, ys in htmltext.labelled_pages(150, seed=1234):
        got = model.decode(bs)
        right, total = right + sum(a == b for a, b in zip(got, ys, strict=True)), total + len(ys)
    assert right / total > 0.96


def test_layouts_that_training_has_not_seen():
    """Articles without a container, from a model that knows only articles with one."""
    model = htmltext.fit(htmltext.labelled_pages(300, bare=0))
    right = total = 0
    for bs, ys in htmltext.labelled_pages(100, seed=77, bare=1):
        got = model.decode(bs)
        right, total = right + sum(a == b for a, b in zip(got, ys, strict=True)), total + len(ys)
    assert right / total > 0.8


def test_hard_pages():
    text = lambda h: htmltext.main_text(h, htmltext.default_model())
    assert text("<html><body><p>First paragraph of the text here.</p><p>Second one, which goes on.</p></body></html>") == "First paragraph of the text here. Second one, which goes on."
    page = '<article><h1>Head</h1><p>Real text of the article, long enough.</p>{}</article>{}'
    for inside, after in (
        ('<div class="comments"><h3>Comments</h3><p>Nice post!</p></div>', ""), ('<div class="comment-form"><h3>Leave a reply</h3><form><label>Name</label></form></div>', ""),
        ("", "<p>© 2024 Example Corp. All rights reserved.</p>"), ("", "<div>Copyright 2024 Example Corp.</div>"), ('<div class="social-share"><a href=x>Share</a></div>', ""),
    ):
        assert text(page.format(inside, after)) == "Head Real text of the article, long enough."


def test_main_text(spark, tmp_path):
    page = """<html><head><title>T</title><script>x</script></head><body><header><p>site name here</p></header><nav><ul><li><a href=/>Home</a></li></ul></nav>
    <div class="cookie-notice"><p>We use cookies.</p></div><div class="ad">Buy now.</div><aside class=sidebar><p>Other news is here.</p></aside>
    <article><h1>The title</h1><p>First &eacute;l&egrave;ve   text,
    on two lines.<p>Second.</p></article><section class="comments"><p>I disagree with this.</p></section><form><label>Mail</label><button>Send</button></form><footer>&copy; 2024</footer></body></html>"""
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (4, "u", "<nav><a href=x>only menu</a></nav>"), (1, "u", page), (5, "u", f"<article>{'<p>long text here.</p>' * 20_000}</article>")]
    out = htmltext.extract(clashing(saved(spark, tmp_path, rows, "page_id long, url string, html string"))).collect()
    got = {r.page_id: r for r in out}
    assert len(out) == 6 and got[1].text == "The title First élève text, on two lines. Second."
    assert (got[2].text, got[3].text, got[4].text, got[2].n_chars) == ("", "", "", 0) and got[5].n_chars == 20_000 * 16 - 1
    assert htmltext.extract(saved(spark, tmp_path, [], "page_id long, url string, html string")).count() == 0


# ---------------------------------------------------------------- toxicity


def labelled(spark, tmp_path, words, n=900):
    r = random.Random(11)
    bad = ["zorgle", "blivet", "grundle"]
    rows, labels = [], []
    for k in range(n):
        t = words(r.randint(5, 80), k)
        toxic = k % 6 == 0
        for _ in range(2 if toxic else 0):
            t.insert(r.randrange(len(t)), r.choice(bad))
        rows.append((k, " ".join(t)))
        if k % 2 == 0:
            labels.append((k, 1, int(toxic)))
    return saved(spark, tmp_path, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {k for k in range(n) if k % 6 == 0}


def test_toxic_texts_are_told_from_positives_and_unlabelled(spark, tmp_path, words):
    docs, labels, toxic = labelled(spark, tmp_path, words)
    out = toxicity.toxicity(docs, labels).collect()
    held = [r for r in out if r.held_out]
    assert 0.2 < len(held) / len(out) < 0.5
    assert sum(r.predicted for r in held if r.doc_id in toxic) >= 0.9 * sum(r.doc_id in toxic for r in held)
    assert sum(r.predicted for r in held if r.doc_id not in toxic) == 0
    # clean labels are no input: without them the scores rank alike
    positive = toxicity.toxicity(docs, labels.withColumn("toxic", F.when((F.col("toxic") == 1) | (F.col("doc_id") % 3 > 0), F.col("toxic"))).where("toxic IS NOT NULL")).collect()
    ranks = lambda rs: {r.doc_id for r in sorted(rs, key=lambda r: -r.score)[: len(toxic)]}
    assert len(ranks(out) & ranks(positive)) >= 0.95 * len(toxic)


def test_held_out_labels_are_never_read(spark, tmp_path, words):
    docs, labels, _ = labelled(spark, tmp_path, words, 400)
    flipped = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda y: {r.doc_id: r.score for r in toxicity.toxicity(docs, y).collect()}
    assert score(labels) == score(flipped)


def test_draws_stay_within_their_bounds_though_ids_repeat(spark, tmp_path):
    docs = saved(spark, tmp_path, [(7, f"text {k % 3}") for k in range(6000)])
    rows = docs.select(F.col("text").alias("_text"), F.monotonically_increasing_id().alias("_row"))
    assert 700 < toxicity._drawn(rows, 1000).count() <= 1000 < toxicity._drawn(rows, 9000).count() == 6000


def test_counts_cover_all_rows(spark, tmp_path):
    texts = ["Red fox", "red RED hens", "blue", "", None]
    docs = saved(spark, tmp_path, list(enumerate(texts))).select(F.col("text").alias("_text"))
    asked = np.array(sorted({f for t in texts for f in toxicity.present(t)}))
    assert toxicity._counted(docs, asked).tolist() == [sum(f in toxicity.present(t) for t in texts) for f in asked]


def test_the_risk_stays_non_negative():
    r = np.random.default_rng(0)
    p = [np.array([1, int(k)], np.int32) for k in r.integers(100, 200, 60)]
    u = [*p[:20], *[np.array([2, int(k)], np.int32) for k in r.integers(100, 200, 200)]]
    chosen = np.array([1, 2, *range(100, 200)])
    w, b = toxicity.train(p, u, 0.1, chosen, steps=600)
    s = lambda x: 1 / (1 + np.exp(-(b + w[np.searchsorted(chosen, x)].sum())))
    assert s([1, 150]) > 0.7 > 0.3 > s([2, 150])


def test_toxicity_takes_odd_rows(spark, tmp_path):
    labels = spark.createDataFrame([(4, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(clashing(saved(spark, tmp_path, ODD)), labels).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out) and {r._text for r in out} == {"clash"}
    none = labels.limit(0)
    assert {r.predicted for r in toxicity.toxicity(saved(spark, tmp_path, ODD), none).collect()} == {0}
    assert toxicity.toxicity(saved(spark, tmp_path, []), labels).count() == 0


# ---------------------------------------------------------------- pipeline


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    raw = spark.read.parquet(f"{sf}/documents.parquet")
    docs, kept = raw, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(docs)
        if name != "sharding":
            assert docs.columns == raw.columns
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in kept]
    assert len(corpus_pipeline.STAGES) == 5 and ids[0] >= ids[1] >= ids[2] >= ids[3] == ids[4]
    before = kept[0].select("doc_id", "text").collect()
    least = {c for *_, c in brute_components([(r.doc_id, r.text) for r in before])}
    assert ids[1] == least
    assert decontaminate.leaks(kept[2], spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
    assert kept[4].count() == kept[3].count() and {r.shard for r in kept[4].collect()} <= set(range(24))
    assert corpus_pipeline.run(spark, sf).count() == kept[4].count()


def test_stages_take_no_documents(spark, tmp_path):
    empty = saved(spark, tmp_path, [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0, name


def test_stages_leave_columns_as_they_are(spark, tmp_path, words):
    """Columns called like those that operators add keep their values; so do rows with nulls."""
    rows = [(k, " ".join(words(30, k)), ["a", "b", None][k % 3]) for k in range(40)] + [(None, None, "a"), (41, "", "b"), (3, " ".join(words(30, 3)), "a")]
    names = ["_copy", "size", "copies", "target", "taken", "source_size", "score", "predicted", "held_out", "shard", "slot", "text_crc32", "_row", "we.ird"]
    base = make(spark, [(k, t, s) for k, t, s in rows]).withColumn("source", F.when(F.col("source") != "s", F.col("source")))
    path = str(tmp_path / "docs")
    base.select("*", *[F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in names]).write.parquet(path)
    docs, sf = spark.read.parquet(path), "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        last = name == corpus_pipeline.STAGES[-1][0]
        kept = [n for n in names if not last or n in ("_copy", "copies", "target", "taken", "source_size", "score", "predicted", "held_out", "_row", "we.ird")]
        assert [c for c in out.columns if c in docs.columns] == docs.columns or last
        got = out.select("doc_id", *[F.col(f"`{n}`") for n in kept]).collect()
        assert got and all(tuple(r)[1:] == tuple(f"{n}{'-' if r.doc_id is None else r.doc_id}" for n in kept) for r in got), name
        assert stage(spark, docs.limit(0), sf).count() == 0


@pytest.mark.parametrize("name", sorted(set(llm.QUERIES) - {"pipeline"}))
def test_queries_return_a_row_per_input(spark, name):
    sf = "/root/testdata/sf0.001"
    out = llm.QUERIES[name](spark, sf)
    if name != "op4_decontaminate":
        source = "pages" if "page_id" in out.columns else "documents"
        assert out.count() == spark.read.parquet(f"{sf}/{source}.parquet").count()
