"""Personal data: fixed patterns and information-theoretic sanitisation (operator 6)."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm._shared import U64, WordHashes, fresh, materialize, rows_of, tidy

#: Kinds of the base patterns in their fixed order, then that of disclosing terms.
KINDS = ("email", "ip", "card", "phone", "term")
#: Slots of the maps that tell which words may be disclosing terms, and which texts may be repeated.
SLOTS = 1 << 25
#: Distinct term hashes a task holds before it hands on its counts.
HELD = 1 << 20
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W\d_]{3,}")
_DIGITS = re.compile(r"[0-9]")


def _emails(text: str):
    """Matches of the e-mail pattern, sought from each @, so that no run is read twice."""
    low = 0
    at = text.find("@")
    while at >= 0:
        part = text[low:at]
        start = low + len(part.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        low = m.end() if m else at + 1
        at = text.find("@", low)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of e-mail, ip, card and phone matches, sorted, in code points."""
    out = []
    if "@" in text:
        out += [(s, 0, e) for s, e in _emails(text)]
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGITS.findall(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _hash(s: str) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass"))).view(np.int64))


def _entities(text: str, spans) -> list[int]:
    """Hashes of the distinct entities of a text."""
    values = {f"{KINDS[k]}:{text[s:e].lower() if k == 0 else ''.join(_DIGITS.findall(text[s:e]))}" for s, k, e in spans}
    return [_hash(v) for v in values]


def _outside(text: str, spans):
    """Words that no base span overlaps, in lower case, with their places."""
    merged = []
    for s, _, e in spans:
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    k = 0
    for m in _WORD.finditer(text):
        while k < len(merged) and merged[k][1] <= m.start():
            k += 1
        if k == len(merged) or m.end() <= merged[k][0]:
            yield m[0].lower(), m.start(), m.end()


def _scan(batches):
    """One row a document with its base spans; where it holds entities, with these and all its words."""
    for ids, keys, texts in rows_of(batches, "doc_id", "text_key", "text"):
        rows = []
        for i, x, t in zip(ids, keys, texts, strict=True):
            spans = base_spans(t)
            text = joined(spans)
            n = [sum(k == kind for _, k, _ in spans) for kind in range(4)]
            terms = [_hash(w) for w in {w for w, _, _ in _outside(t, spans)}] if spans else []
            rows.append((i, x, *n, hashlib.sha256(text.encode()).hexdigest(), [{"at": s, "kind": k, "to": e} for s, k, e in spans], _entities(t, spans), terms))
        kinds = [pa.int64(), pa.int64(), *[pa.int64()] * 4, pa.string(), pa.list_(pa.struct([("at", pa.int32()), ("kind", pa.int32()), ("to", pa.int32())])), *[pa.list_(pa.int64())] * 2]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names=["doc_id", "text_key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "entities", "terms"])


_SCANNED = "doc_id long, text_key long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<at:int,kind:int,to:int>>, entities array<long>, terms array<long>"


def _map(slots: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(slots, np.uint8), bitorder="little").view(bool)


def _places(slots: bytes):
    """A row for each word that the map lets pass, with its place."""

    def run(batches):
        marked, cache = _map(slots), WordHashes()
        for ids, keys, texts in rows_of(batches, "doc_id", "text_key", "text"):
            rows = []
            for i, x, t in zip(ids, keys, texts, strict=True):
                hit = {w for w in {w.lower() for w in _WORD.findall(t)} if marked[cache[w] & SLOTS - 1]}
                if hit:
                    rows += [(i, x, _hash(w), s, e) for w, s, e in _outside(t, base_spans(t)) if w in hit]
            kinds = [pa.int64()] * 3 + [pa.int32()] * 2
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names=["doc_id", "text_key", "term", "at", "to"])

    return run


def _slots(hashes: DataFrame) -> bytes:
    """A map of fixed size in which every hash of the one column has its slot set; others may share it."""
    slot = F.col(hashes.columns[0]).bitwiseAND(SLOTS - 1)
    parts = hashes.groupBy(F.shiftright(slot, 5).alias("part")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({hashes.columns[0]} & 31 as int))")).alias("bits")).toArrow()
    out = np.zeros(SLOTS // 32, "<u4")
    out[parts["part"].to_numpy()] = parts["bits"].to_numpy().astype("<u4")
    return out.tobytes()


def _repeated(slots: bytes):
    """The texts whose key the map lets pass."""

    def run(batches):
        marked = _map(slots)
        for batch in batches:
            hit = marked[batch.column("text_key").to_numpy() & (SLOTS - 1)]
            yield batch.filter(pa.array(hit))

    return run


def _count_terms(slots: bytes | None = None):
    """Texts that hold each term, added up in the task before they are shuffled; without those the map lets pass."""

    def run(batches):
        marked = None if slots is None else _map(slots)
        cache, parts, held = WordHashes(), [], 0

        def flush():
            keys = np.concatenate([p[0] for p in parts])
            counts = np.concatenate([p[1] for p in parts])
            u, inverse = np.unique(keys, return_inverse=True)
            return u, np.bincount(inverse, weights=counts).astype(np.int64)

        def batch(pair):
            return pa.record_batch([pa.array(pair[0].view(np.int64), pa.int64()), pa.array(pair[1], pa.int64())], names=["term", "df"])

        for keys, texts in rows_of(batches, "text_key", "text"):
            for x, t in zip(keys, texts, strict=True):
                words = {w.lower() for w in _WORD.findall(t)} if marked is None or not marked[x & SLOTS - 1] else ()
                if not words:
                    continue
                parts.append((np.fromiter(map(cache.__getitem__, words), U64, len(words)), np.ones(len(words), np.int64)))
                held += len(words)
                if held >= 2 * HELD:
                    pair = flush()
                    parts, held = [pair], len(pair[0])
                    if held > HELD:
                        yield batch(pair)
                        parts, held = [], 0
        if parts:
            yield batch(flush())

    return run


@dataclass
class Findings:
    """What ``find`` gives: a row a document, and the terms to hide in them."""

    documents: DataFrame
    terms: DataFrame


def _lower(k, n, z: float):
    """The lower end of Wilson's interval for ``k`` of ``n``, one-sided at ``z`` deviations."""
    p = k / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def find(docs: DataFrame, alpha: float = 1.25, z: float = 1.645) -> Findings:
    """Base spans of every whole text, and the terms that disclose a protected entity.

    Entities are the values of the base patterns. Over all distinct texts (so
    copies of one text are no evidence) the operator counts N, the texts that
    hold an entity e, a term t, and both of them, anywhere. p(e|t) is taken at
    the lower end of its confidence interval (Wilson, ``z`` deviations), so one
    or two texts can be evidence, but less than many. t discloses e if the
    mutual information log(N p(e|t) / n(e)) is at least the information content
    log(N / n(e)) divided by ``alpha``. Where every text with t has e too the
    term is removed, else it is generalised, at all its places in all texts.

    Entities that occur in the same texts share their counts and are counted
    as one class, and so are terms; pairs are formed of classes, and only of
    those that could reach the threshold if they always occurred together.

    Null text is empty; rows without doc_id are kept under null; rows that
    repeat a doc_id are told apart by their text; other columns are ignored;
    no rows give no rows.
    """
    base = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    scanned = materialize(base.mapInArrow(tidy(_scan), _SCANNED))
    texts = scanned.groupBy("text_key").agg(F.count("*").alias("n"))
    total = F.lit(texts.count())
    repeated = _slots(texts.where("n > 1").select("text_key"))
    holders = materialize(scanned.where(F.size("entities") > 0).select("text_key", "entities", "terms").dropDuplicates(["text_key"]))
    alike = F.bit_xor(F.xxhash64("text_key"))
    held = holders.select("text_key", F.explode("entities").alias("entity"))
    entities = held.groupBy("entity").agg(F.count("*").alias("n_entity"), alike.alias("entities"))
    held = held.join(entities, "entity").select("text_key", "n_entity", "entities").distinct()
    said = holders.select("text_key", F.explode("terms").alias("term"))
    again = base.select("text_key", "text").mapInArrow(tidy(_repeated(repeated)), "text_key long, text string").distinct()
    counted = base.mapInArrow(tidy(_count_terms(repeated)), "term long, df long").unionByName(again.mapInArrow(tidy(_count_terms()), "term long, df long"))
    frequency = counted.groupBy("term").agg(F.sum("df").alias("n_term"))
    terms = materialize(said.groupBy("term").agg(F.count("*").alias("n_held"), alike.alias("terms")).join(frequency, "term"))
    said = said.join(terms, "term").select("text_key", "n_term", "n_held", "terms").distinct()
    content = F.log(total / F.col("n_entity"))
    discloses = lambda both: (content > 0) & (content + F.log(_lower(both, F.col("n_term"), z)) >= content / alpha)
    pairs = held.join(said, "text_key").where(discloses(F.least("n_entity", "n_held"))).groupBy("n_entity", "entities", "n_term", "n_held", "terms").agg(F.count("*").alias("both"))
    classes = pairs.where(discloses(F.col("both"))).groupBy("n_term", "n_held", "terms").agg(F.max(F.col("both") == F.col("n_term")).alias("remove"))
    flagged = materialize(terms.join(classes, ["n_term", "n_held", "terms"]).select("term", "remove"))
    places = base.mapInArrow(tidy(_places(_slots(flagged.select("term")))), "doc_id long, text_key long, term long, at int, to int")
    hidden = places.join(flagged, "term").groupBy("doc_id", "text_key", "at", "to").agg(F.max("remove").alias("remove"))
    hidden = hidden.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("at", F.lit(4).alias("kind"), "to", "remove"))).alias("added"))
    return Findings(scanned, hidden)


def spans(docs: DataFrame, alpha: float = 1.25, z: float = 1.645) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row; see ``find``."""
    got = find(docs, alpha, z)
    hidden = got.terms.select(F.col("doc_id").alias("d"), F.col("text_key").alias("x"), F.transform("added", lambda a: F.struct(a["at"].alias("at"), a["kind"].alias("kind"), a["to"].alias("to"))).alias("added"))
    both = got.documents.join(hidden, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("x")), "left")
    every = F.sort_array(F.concat("base", F.coalesce("added", F.slice("base", 1, 0))))
    names = F.array(*[F.lit(k) for k in KINDS])
    text = F.array_join(F.transform(every, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["at"].cast("string"), s["to"].cast("string"))), ",")
    return both.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", text.alias("spans"))


def _rewriter(column: str):
    def rewrite(batches):
        for batch in batches:
            texts, added = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("text", column))
            out = []
            for t, a in zip(texts, added, strict=True):
                base = base_spans(t or "")
                if not base and not a:
                    out.append(t)
                    continue
                marks = sorted([(s, e, f"<{KINDS[k].upper()}>") for s, k, e in base] + [(s["at"], s["to"], "" if s["remove"] else "<TERM>") for s in a or []])
                text, parts, end = t or "", [], 0
                for s, e, mark in marks:
                    if s < end:  # overlaps the span before: extend it
                        end = max(end, e)
                        continue
                    parts += [text[end:s], mark]
                    end = e
                out.append("".join([*parts, text[end:]]))
            names = [n for n in batch.schema.names if n != column]
            yield pa.record_batch([pa.array(out, pa.string()) if n == "text" else batch.column(n) for n in names], names=names)

    return rewrite


def sanitise(docs: DataFrame, alpha: float = 1.25, z: float = 1.645) -> DataFrame:
    """``docs`` with every base span replaced by its kind and disclosing terms removed or generalised.

    Documents without spans pass unchanged, null texts included. Base spans
    are sought where the row is read; only terms are joined, by text and by
    doc_id, null or not. Repeated rows are all kept and all rewritten; other
    columns stay, whatever their names; no rows give no rows.
    """
    i, x, added = fresh(docs, "hidden_id", "hidden_key", "hidden_spans")
    hidden = find(docs, alpha, z).terms.select(F.col("doc_id").alias(i), F.col("text_key").alias(x), F.col("added").alias(added))
    key = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    wide = docs.join(hidden, docs["doc_id"].cast("long").eqNullSafe(F.col(i)) & (key == F.col(x)), "left")
    return wide.select(*[docs[n] for n in docs.columns], added).mapInArrow(tidy(_rewriter(added)), docs.schema)
