"""Personal data: patterns, and terms that reveal whose they are, found by co-occurrence over the corpus.

Base spans follow four patterns. The values that they find are the protected entities. A term that stands near a value
(``REACH`` words on the same line) may reveal it: with the corpus as evidence, ``PMI(value; term) / IC(value)`` is 1
for a term that is never seen without the value and falls with every place where it is. A term that reaches
``THRESHOLD`` over at least ``SUPPORT`` places is disclosing, and all its occurrences are spans (``term``).

Evidence is counted by place, not by document: a place is the hash of the two words before and the two after a term or a
value on its line, base spans left out. Copies of a document repeat its places and prove nothing by their number, so the terms of a
text that was merely copied aren't taken for revealing; a term and a value are seen together as often as both are in
different places. How many places there are is taken to be the number of words of all different texts.

Counts cover all documents. The threshold is a most number of places for a term (its limit); a term that has more of them
near values alone is none. The others are few and are counted over the corpus, where a table of bounded size, limits by
the terms' hashes, lets nearly nothing else into the shuffle, and a task that has found a term in more places than its limit
says so once. An exact join follows.

Terms have ``LEAST_CHARS`` code points or more.

Nulls: a null text is empty and has no spans. Repeated rows have the same spans each and count as one place. An empty
table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framerank.llm.common import cut, trimming

KINDS = ("email", "ip", "card", "phone")
#: Documents of a batch that are worked on at once.
PART = 500
REACH = 8
SUPPORT = 3
THRESHOLD = 0.95
LEAST_CHARS = 2
#: Bytes of the table of limits, a power of two: about 16 a term, but no less and no more than these.
FEWEST_SLOTS, MOST_SLOTS = 1 << 21, 1 << 26

#: The pattern of an e-mail address from its @ on, and the letters before it.
AFTER_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LINE_OR_TERM = re.compile(r"\n|[^\W_]+(?:['’-][^\W_]+)*")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses, found from their @ signs: what is before one is looked at once."""
    last = seen = 0
    for m in AFTER_AT.finditer(text):
        low = max(last, seen)
        before = text[low : m.start()]
        start = low + len(before.rstrip(LOCAL))
        seen = m.start() + 1
        if start < m.start():
            last = m.end()
            yield start, last


def base_spans(text: str) -> list[Span]:
    """Spans of the four patterns, by start and then kind."""
    out: list[Span] = []
    if "@" in text:
        out += [(a, 0, b) for a, b in emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if 14 <= m.end() - m.start() and 14 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out)


def written(spans: list[Span], names: tuple[str, ...] = (*KINDS, "term")) -> str:
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def words_of(text: str, spans: list[Span]) -> tuple[list[str], list[int], list[int]]:
    """The terms of a text and its line ends, with where they start and end; what overlaps a base span is left out."""
    words, starts, ends, k, until = [], [], [], 0, 0
    for m in LINE_OR_TERM.finditer(text):
        a, b = m.span()
        while k < len(spans) and spans[k][0] < b:  # spans that begin before the term's end: the furthest end among them decides
            until = max(until, spans[k][2])
            k += 1
        if a >= until:
            words.append(m[0].lower()), starts.append(a), ends.append(b)
    return words, starts, ends


def _side(words: list[str], i: int, step: int, most: int) -> list[int]:
    """Up to ``most`` terms from ``i`` on, in either direction, on the same line."""
    out = []
    while 0 <= i < len(words) and len(out) < most and words[i] != "\n":
        out.append(i)
        i += step
    return out


def _place(words: list[str], i: int) -> int:
    """The place of the term at ``i``."""
    return _hash(*(words[k] for k in (*reversed(_side(words, i - 1, -1, 2)), i, *_side(words, i + 1, 1, 2))))


def evidence(text: str, spans: list[Span]) -> list[tuple[str, int, str, int]]:
    """Value and its place, term and its place, for the terms near base spans."""
    words, starts, _ = words_of(text, spans)
    found, places = [], {}
    for start, kind, end in spans:
        value = f"{KINDS[kind]}:{text[start:end].lower()}"
        i = bisect_left(starts, start)
        before, after = _side(words, i - 1, -1, REACH), _side(words, i, 1, REACH)
        at = _hash(*(words[k] for k in (*reversed(before[:2]), *after[:2])))
        for k in (*before, *after):
            if len(words[k]) >= LEAST_CHARS:
                if k not in places:
                    places[k] = _place(words, k)
                found.append((value, at, words[k], places[k]))
    return found


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, PART):
            yield batch.slice(at, PART)


def _scan(docs: DataFrame) -> DataFrame:
    """``doc_id, h`` (hash of the text), ``n_words``, ``base`` spans and ``near``, the evidence, of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
        clue = pa.struct([("value", pa.string()), ("at", pa.int64()), ("term", pa.string()), ("place", pa.int64())])
        for batch in _parts(batches):
            base, near, n_words = [], [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                spans = base_spans(text)
                n_words.append(len(text.split()))
                base.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
                near.append([dict(zip(("value", "at", "term", "place"), e, strict=True)) for e in evidence(text, spans)] if spans else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(n_words, pa.int64()), pa.array(base, pa.list_(kind)), pa.array(near, pa.list_(clue))], ["doc_id", "h", "n_words", "base", "near"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text")
    return rows.mapInArrow(trimming(run), "doc_id long, h long, n_words long, base array<struct<start: int, kind: int, end: int>>, near array<struct<value: string, at: long, term: string, place: long>>")


def disclosing(docs: DataFrame, scanned: DataFrame, support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame | None:
    """``term``s that disclose a value; ``None`` if no term has the support.

    ``PMI / IC >= threshold`` is ``n_t <= n_vt * (n / n_v) ** (1 - threshold)`` with the places of the term, of both together,
    of the value and all.
    """
    n = float(max(2, scanned.groupBy("h").agg(F.first("n_words").alias("n")).agg(F.sum("n")).first()[0] or 0))
    clues = cut(scanned.select(F.explode("near").alias("c")).select("c.*").distinct(), "clues")
    joint = clues.groupBy("value", "term").agg(F.least(F.countDistinct("place"), F.countDistinct("at")).alias("n_vt")).where(F.col("n_vt") >= support)
    n_v = clues.select("value", "at").distinct().groupBy("value").agg(F.count(F.lit(1)).alias("n_v"))
    near = clues.select("term", "place").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_near"))
    limit = F.col("n_vt") * F.pow(F.greatest(F.lit(n) / F.col("n_v"), F.lit(1.0)), F.lit(1.0 - threshold))
    limits = joint.join(n_v, "value").withColumn("limit", limit).groupBy("term").agg(F.max("limit").alias("limit"))
    limits = cut(limits.join(near, "term").where("n_near <= limit").select("term", "limit"), "limits")
    table = limit_table(limits)
    if table is None:
        return None
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, set[int] | None] = {}  # a term's places in this task; None once they are too many
        for batch in _parts(batches):
            terms, places = [], []
            for text in batch.column("text"):
                for t, _, _, place, most in occurrences(text.as_py() or "", shared.value):
                    found = known.setdefault(t, set())
                    if found is not None and place not in found:
                        found.add(place)
                        if len(found) > most:
                            known[t], place = None, None
                        terms.append(t), places.append(place)
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(places, pa.int64())], ["term", "place"])

    seen = docs.select("text").mapInArrow(trimming(run), "term string, place long").distinct()
    n_t = seen.groupBy("term").agg(F.count("place").alias("n_t"), F.count_if(F.col("place").isNull()).alias("over"))
    return cut(limits.join(n_t, "term").where("over = 0 and n_t <= limit").select("term"), "terms")


def limit_table(limits: DataFrame) -> bytes | None:
    """By slot, the power of two that no limit of its terms exceeds, plus one; 0 without terms. ``None`` without any."""
    n = limits.count()
    if not n:
        return None
    slots = min(MOST_SLOTS, max(FEWEST_SLOTS, 1 << (16 * n - 1).bit_length()))
    slot = F.pmod(F.xxhash64("term"), F.lit(slots)).cast("int")
    level = F.least(F.ceil(F.log2(F.greatest("limit", F.lit(1.0)))) + 1, F.lit(63)).cast("long")
    levels = limits.groupBy(slot.alias("slot")).agg(F.max(level).alias("level"))
    rows = levels.groupBy((F.col("slot") / 8).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(level, slot % 8 * 8)")).alias("eight")).collect()  # at most `slots` / 8 rows
    out = np.zeros(slots // 8, dtype="<u8")
    for r in rows:
        out[r["at"]] = r["eight"] & 0xFFFFFFFFFFFFFFFF
    return out.tobytes()


_HASHES: dict[str, int] = {}


def _term_hash(term: str) -> int:
    """What Spark's ``xxhash64`` gives a term, without sign; kept for the worker's frequent terms."""
    if (found := _HASHES.get(term)) is None:
        from xxhash import xxh64_intdigest

        if len(_HASHES) >= 500_000:
            _HASHES.clear()
        found = _HASHES[term] = xxh64_intdigest(term.encode("utf-8", "surrogatepass"), seed=42)
    return found


def occurrences(text: str, table: bytes) -> Iterator[tuple[str, int, int, int, int]]:
    """Term, start, end, place and the bound on the limit, of the terms that the table lets through."""
    last = len(table) - 1  # a power of two less one
    if not any(table[_term_hash(w.lower()) & last] for w in set(LINE_OR_TERM.findall(text)) if len(w) >= LEAST_CHARS):
        return
    words, starts, ends = words_of(text, base_spans(text))
    for i, w in enumerate(words):
        if len(w) >= LEAST_CHARS and (level := table[_term_hash(w) & last]):
            yield w, starts[i], ends[i], _place(words, i), 1 << (level - 1)


def term_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``doc_id, h, terms``: the spans of disclosing terms, for the documents that have some."""
    table = limit_table(terms.withColumn("limit", F.lit(1.0)))
    if table is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, h long, terms array<struct<start: int, kind: int, end: int>>")
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            out: list[tuple] = []
            for doc_id, h, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "h", "text")), strict=True):
                out += [(doc_id, h, t, a, b) for t, a, b, _, _ in occurrences(text or "", shared.value)]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["doc_id", "h", "term", "start", "end"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text").mapInArrow(trimming(run), "doc_id long, h long, term string, start int, end int")
    spans = rows.join(terms, "term", "left_semi").select("doc_id", "h", F.struct("start", F.lit(len(KINDS)).alias("kind"), "end").alias("s"))
    return spans.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("s")).alias("terms"))


def find(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms`` and ``n_spans``, those of all kinds."""
    scanned = cut(_scan(docs), "spans")
    terms = disclosing(docs, scanned)
    rows = scanned.select("doc_id", "h", "base")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    if terms is None:
        rows = rows.withColumn("terms", none)
    else:
        added = term_spans(docs, terms).select(F.col("doc_id").alias("__d"), F.col("h").alias("__h"), "terms")
        rows = rows.join(added, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("h") == F.col("__h")), "left").withColumn("terms", F.coalesce("terms", none))
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(k):
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.sort_array(F.concat("base", "terms"))).alias("spans"), F.size("terms").cast("long").alias("n_terms"), (F.size("base") + F.size("terms")).cast("long").alias("n_spans"))


def replaced(text: str, spans: list[Span]) -> str:
    """Values give way to their kind; disclosing terms are generalised to ``[NAME]`` or ``[NUMBER]`` or else removed."""
    out, at = [], 0
    for a, kind, b in sorted(spans):
        if a < at:  # what overlaps is replaced once; a longer span takes the rest along
            at = max(at, b)
            continue
        word = text[a:b]
        new = f"[{KINDS[kind].upper()}]" if kind < len(KINDS) else "[NUMBER]" if word.isdigit() else "[NAME]" if word[:1].isupper() else ""
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]])


def sanitised(docs: DataFrame) -> DataFrame:
    """The documents with their columns, spans replaced in ``text`` and ``n_chars`` (where there is one) counted anew."""
    terms = disclosing(docs, cut(_scan(docs), "spans"))
    rows, names = docs, docs.columns
    if terms is not None:
        key = F.xxhash64(F.coalesce("text", F.lit("")))
        added = term_spans(docs, terms).select(F.col("doc_id").alias("__d"), F.col("h").alias("__h"), "terms")
        rows = docs.join(added, F.col("doc_id").eqNullSafe(F.col("__d")) & (key == F.col("__h")), "left").select(*docs.columns, F.col("terms").alias("__terms"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            terms_of = batch.column("__terms").to_pylist() if "__terms" in batch.schema.names else [None] * batch.num_rows
            texts = []
            for text, more in zip(batch.column("text"), terms_of, strict=True):
                text = text.as_py()
                spans = base_spans(text or "") + [(s["start"], s["kind"], s["end"]) for s in more or []]
                texts.append(replaced(text, spans) if spans else text)
            out = {n: batch.column(n) for n in names}
            out["text"] = pa.array(texts, batch.column("text").type)
            if "n_chars" in out:
                out["n_chars"] = pa.array([len(t or "") for t in texts], out["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return rows.mapInArrow(trimming(run), docs.schema)
