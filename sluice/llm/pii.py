"""Personal data and information-theoretic sanitisation.

Base entities (e-mail, ip, card, phone) are found by pattern, secrets (keys, tokens, passwords) by known formats and as long mixtures of letters
and digits. Beyond them, terms are found that reveal an entity: over the corpus, a term t discloses an entity e when their
pointwise mutual information reaches a share of what e itself says, PMI(t; e) >= IC(e) / alpha with IC(e) = -log2 p(e). That is
log2 p(e|t) >= IC(e) * (1 / alpha - 1). p(e|t) comes from counts over all documents: in how many t stands within WINDOW words of e,
and in how many it stands at all.

Most personal data stand in one document, where nothing can be estimated. So entities are protected at three levels: as
themselves, as their class (the domain of an e-mail, the alphabet and length of a secret), and as their kind. A word that stands hardly anywhere but beside
cards discloses a card, whichever it is. Terms are judged that stand beside e in at least SUPPORT documents; an
entity of fewer documents still has its class and kind.

Documents that mention e then have such terms removed, wherever they stand in them, and e itself generalised to its kind.

One scan finds entities and their surroundings; a second counts, over every text, the terms that passed the
support threshold; a third looks through the whole of the texts with entities for the terms that disclose one of theirs, and carries those texts on. Terms are
known to the scans by bitmaps of fixed size, whose false positives an exact join removes.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, cut, lookup, whole_texts

KINDS = ("email", "ip", "card", "phone", "secret", "term")
SECRET, TERM = 4, 5
#: Words on either side of an entity that count as its context.
WINDOW = 8
#: Documents in which a term must stand beside an entity before it can disclose it.
SUPPORT = 3
#: 1: only terms that stand nowhere but beside the entity. Larger: weaker hints count too.
ALPHA = 1.25
BITS = 23

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")
# Formats of access keys (cloud, code hosting, chat, maps), signed tokens and private keys.
_FORMATS = re.compile(
    r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36,}|\bxox[abprs]-[A-Za-z0-9-]{10,}|\bAIza[A-Za-z0-9_-]{35}|\bsk-[A-Za-z0-9_-]{20,}"
    r"|\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*|-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----"
)
_FORMAT_HINTS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "AIza", "sk-", "eyJ", "PRIVATE KEY")
#: Letters and digits in turn, this often and over at least this many characters, are no word.
TURNS, LONG = 3, 16
_MIXED = re.compile(r"[A-Za-z0-9_]{%d,}" % LONG)
_TURN = re.compile(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def find(text: str) -> list[tuple[int, int, int]]:
    """Base entities as (start, kind, end), code points, by start, then kind; time linear in the text."""
    out, at = [], 0
    i = text.find("@")
    while i >= 0:
        start = i
        while start > at and text[start - 1] in _LOCAL:
            start -= 1
        if start < i and (m := _DOMAIN.match(text, i + 1)):
            out.append((start, 0, m.end()))
            at = m.end()
        else:
            at = i + 1
        i = text.find("@", at)
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def union(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """(starts, ends) of the stretches that `spans` cover."""
    starts, ends = [], []
    for s, e in sorted(spans):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def meets(covered: tuple[list[int], list[int]], s: int, e: int) -> bool:
    k = bisect_left(covered[0], e) - 1
    return k >= 0 and covered[1][k] > s


def secrets(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Secrets outside base entities as (start, kind, end); known formats first, then mixtures that meet none of them."""
    covered, out = union([(s, e) for s, _, e in base]), []
    if any(x in text for x in _FORMAT_HINTS):
        out = [m.span() for m in _FORMATS.finditer(text) if not meets(covered, *m.span())]
        covered = union([*zip(*covered, strict=True), *out])
    if _DIGIT.search(text):
        out += [m.span() for m in _MIXED.finditer(text) if len(_TURN.findall(m[0])) >= TURNS and not meets(covered, *m.span())]
    return [(s, SECRET, e) for s, e in out]


def protected(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base entities, base entities and secrets), each by start, then kind."""
    base = find(text)
    more = secrets(text, base)
    return base, sorted(base + more) if more else base


def levels(text: str, span: tuple[int, int, int]) -> list[str]:
    """An entity as itself, as its class where there is one, and as its kind."""
    s, k, e = span
    kind, own = KINDS[k], text[s:e]
    out = [f"{kind}:{own.lower()}", kind]
    if kind == "email":
        out.append(f"{kind}@{own.rpartition('@')[2].lower()}")
    elif k == SECRET:
        alphabet = "hex" if re.fullmatch("[0-9a-f]+", own) else "upper" if own == own.upper() else "lower" if own == own.lower() else "any"
        out.append(f"{kind}/{alphabet}{e - s}")
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def contexts(text: str, spans: list[tuple[int, int, int]], window: int = WINDOW) -> set[tuple[str, str]]:
    """(entity at each of its levels, term) for the terms within `window` words of each entity, outside all entities."""
    found: set[tuple[str, str]] = set()
    covered = union([(s, e) for s, _, e in spans])
    for s, k, e in spans:
        left, right = max(0, s - 24 * window), min(len(text), e + 24 * window)
        before = [m for m in _TERM.finditer(text, left, s)]
        if left and before and before[0].start() == left:
            before = before[1:]  # may be cut
        after = [m for m in _TERM.finditer(text, e, right)]
        if right < len(text) and after and after[-1].end() == right:
            after = after[:-1]
        own = levels(text, (s, k, e))
        for m in (*before[-window:], *after[:window]):
            a, b = m.span()
            if not meets(covered, a, b):
                found.update((entity, m[0].lower()) for entity in own)
    return found


_COUNTS = ["n_email", "n_ip", "n_card", "n_phone", "n_secret"]
_SCAN = "_row long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", base_sha256 string, plain_sha256 string, near array<struct<entity:string,term:string>>"


def scan(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Entities of each text (null: empty) with the terms around them; the hash of texts without any."""
    fields = {f.name: f.dataType for f in docs.schema.fields}
    schema = ", ".join(f"`{c}` {fields[c].simpleString()}" for c in keep) + (", " if keep else "") + _SCAN
    names = [f.split()[0] for f in _SCAN.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row, t in zip(batch["_row"], batch["_text"], strict=True):
                t = t or ""
                base, spans = protected(t)
                n = [0] * len(_COUNTS)
                for _, k, _ in spans:
                    n[k] += 1
                near = [{"entity": e, "term": w} for e, w in sorted(contexts(t, spans))] if spans else []
                plain = None if spans else hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((row, *n, hashlib.sha256(listed(base).encode()).hexdigest(), plain, near))
            out = pd.DataFrame(rows, columns=names)
            for c in keep:
                out[c] = batch[c].to_numpy()
            yield out[[*keep, *names]]

    return docs.select(*keep, F.monotonically_increasing_id().alias("_row"), F.col(text).alias("_text")).mapInPandas(run, schema)


def frequencies(docs: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    """(term, n): in how many of all documents each of `terms` stands."""
    bits = np.frombuffer(bitmap(terms.select(F.crc32(F.col("term").cast("binary")).alias("h")), "h", BITS), np.uint8)
    mask = (1 << BITS) - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flags, known, counts = np.unpackbits(bits, bitorder="little").tobytes(), {}, Counter()
        for batch in batches:
            for t in batch["t"]:
                if t:
                    hits = []
                    for w in set(_TERM.findall(t.lower())):
                        hit = known.get(w)
                        if hit is None:
                            if len(known) > 200_000:
                                known.clear()
                            hit = known[w] = flags[zlib.crc32(w.encode()) & mask]
                        if hit:
                            hits.append(w)
                    counts.update(hits)
            if len(counts) > 200_000:
                yield pd.DataFrame({"term": list(counts), "n": list(counts.values())})
                counts.clear()
        if counts:
            yield pd.DataFrame({"term": list(counts), "n": list(counts.values())})

    return docs.select(F.col(text).alias("t")).mapInPandas(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def occurrences(text: str, spans: list[tuple[int, int, int]], wanted: Callable[[str], bool]) -> dict[str, list[int]]:
    """{term: [start, end, ...]} for all `wanted` terms of the text outside its entities."""
    found: dict[str, list[int]] = {}
    at = 0
    for start, _, end in [*spans, (len(text), 0, len(text))]:
        for m in _TERM.finditer(text, at, start) if at < start else ():
            if wanted(term := m[0].lower()):
                found.setdefault(term, []).extend(m.span())
        at = max(at, end)
    return found


def everywhere(docs: DataFrame, text: str, disclosing: DataFrame) -> DataFrame:
    """(_row, _text, own, hits): the texts with entities, their spans, and the places (pair, at) of terms that may be `disclosing` (term and pair) one of them."""
    crc = lambda c: disclosing.select(F.crc32(F.col(c).cast("binary")).alias("h"))
    of_term, of_pair = (np.frombuffer(bitmap(crc(c), "h", BITS), np.uint8) for c in ("term", "pair"))
    mask = (1 << BITS) - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms, pairs = (np.unpackbits(b, bitorder="little").tobytes() for b in (of_term, of_pair))
        for batch in batches:
            rows = []
            for row, t in zip(batch["_row"], batch["_text"], strict=True):
                _, spans = protected(t or "")
                if spans:
                    stand, hits = occurrences(t, spans, lambda w: terms[zlib.crc32(w.encode()) & mask]), []
                    for e in sorted({x for s in spans for x in levels(t, s)}) if stand else ():
                        for w, at in stand.items():
                            pair = f"{e}\u0001{w}"
                            if pairs[zlib.crc32(pair.encode()) & mask]:
                                hits.append({"pair": pair, "at": at})
                    rows.append((row, t, listed(spans), hits))
            yield pd.DataFrame(rows, columns=["_row", "_text", "own", "hits"])

    asked = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(text).alias("_text"))
    return asked.mapInPandas(run, "_row long, _text string, own string, hits array<struct<pair:string,at:array<int>>>")


def disclosures(found: DataFrame, docs: DataFrame, text: str, support: int = SUPPORT, alpha: float = ALPHA) -> DataFrame:
    """(pair, term, hit): the terms that disclose an entity, pair being both. `found` is what `scan` gave for `docs`."""
    near = found.select("_row", F.explode("near").alias("x")).select("_row", "x.*").withColumn("pair", F.concat_ws("\u0001", "entity", "term"))
    pairs = near.groupBy("pair").agg(F.first("entity").alias("entity"), F.first("term").alias("term"), F.count("*").alias("both")).where(F.col("both") >= support)
    pairs = cut(pairs)
    total = found.count()
    of_entity = near.select("_row", "entity").distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
    of_entity = of_entity.join(pairs.groupBy("entity").agg(F.count("*").alias("pairs")), "entity")
    of_term = frequencies(docs, text, pairs.select("term").distinct())
    of_term = of_term.join(pairs.groupBy("term").agg(F.count("*").alias("pairs")), "term")
    judged = lookup(lookup(pairs, of_entity, "entity", "pairs", F.xxhash64("term")), of_term, "term", "pairs", F.xxhash64("entity"))
    ic = -F.log2(F.col("n_e") / F.lit(float(max(total, 1))))
    hint = F.log2(F.col("both") / F.greatest(F.col("n"), F.col("both")))
    return judged.where((ic > 0) & (hint >= ic * F.lit(1.0 / alpha - 1.0))).select("pair", "term", F.lit(True).alias("hit"))


def sanitise(docs: DataFrame, id: str = "doc_id", text: str = "text", support: int = SUPPORT, alpha: float = ALPHA) -> DataFrame:
    """One row per document: id, n_email, n_ip, n_card, n_phone, n_secret, `base_sha256`, `spans`, `sanitised` and `sanitised_sha256`.

    spans lists kind:start:end (code points, end exclusive) by start, then kind; kind `secret` marks keys, tokens and passwords, kind `term` the terms that
    disclose an entity of the same document, at all their places in it. base_sha256 is that of the base entities' list. sanitised is the text with its
    spans replaced, null where there is nothing to replace; the hash is of the text to be used in either case. Null and empty texts have no spans. Rows
    that repeat are each a document. `docs` must be the same when it is read again, as a scan of files is. Columns other than id and text are not read.
    """
    whole_texts(docs.sparkSession)
    found = cut(scan(docs, text, [id]))
    disclosing = cut(disclosures(found, docs, text, support, alpha))
    held = cut(everywhere(docs, text, disclosing))
    places = held.select("_row", F.explode("hits").alias("x")).select("_row", "x.*")
    weighed = places.groupBy("pair").agg(F.count("*").alias("rows")).join(disclosing.drop("term"), "pair")
    hits = lookup(places, weighed, "pair", "rows", F.col("_row")).where("hit").groupBy("_row").agg(F.flatten(F.collect_list("at")).alias("terms"))

    @F.pandas_udf("spans string, sanitised string, sha string")
    def finish(texts: pd.Series, own: pd.Series, terms: pd.Series) -> pd.DataFrame:
        out = []
        for x, o, t in zip(texts, own, terms, strict=True):
            spans = {(int(s), KINDS.index(k), int(e)) for k, s, e in (y.split(":") for y in o.split(","))}
            if t is not None:
                spans |= {(int(s), TERM, int(e)) for s, e in zip(t[::2], t[1::2], strict=True)}
            clean = replaced(x, sorted(spans))
            out.append((listed(sorted(spans)), clean, hashlib.sha256(clean.encode("utf-8", "surrogatepass")).hexdigest()))
        return pd.DataFrame(out, columns=["spans", "sanitised", "sha"])

    done = held.join(hits, "_row", "left").withColumn("_f", finish("_text", "own", "terms")).select("_row", "_f.*")
    whole = found.drop("near").join(done, "_row", "left")
    return whole.select(id, *_COUNTS, "base_sha256", F.coalesce("spans", F.lit("")).alias("spans"), "sanitised", F.coalesce("sha", "plain_sha256").alias("sanitised_sha256"))


def replaced(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced: entities by <KIND>, disclosing terms by <REDACTED>. Overlapping spans count as one."""
    parts, at = [], 0
    for s, k, e in spans:
        if s >= at:
            parts += [text[at:s], "<REDACTED>" if k == TERM else f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    return "".join(parts) + text[at:]
