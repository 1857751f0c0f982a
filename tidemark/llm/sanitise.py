"""Information-theoretic sanitisation of personal data.

Entities to protect are the values that the patterns find (e-mail and IP addresses, card and phone numbers), and the
classes that they belong to: their kind, and for e-mail addresses the domain. A term near an entity may give it away:
over the whole corpus, for entity e and term t,

    disclosure(t, e) = PMI(t; e) / IC(e) = log(n(t, e) N / (n(t) n(e))) / log(N / n(e))

where all four count distinct texts: N all of them, n(t) those with t, n(e) those with e, and n(t, e) those with t in a
context of e (the ``reach`` words on both sides, without those inside of any value). It is 1 when t stands nowhere but
near e, and about 0 when t is independent of e; copies of a text change nothing. Terms at or above ``threshold`` that
stand in ``support`` contexts of different wording are generalised (``[TERM]``) wherever a document has both, or taken
out.

Cases: a null or empty text has no spans; a value that repeats in a document is a span each time; repeated rows give a
row each; without documents, entities or terms above the threshold only base spans remain; sanitised() carries all other
columns, whatever their names, sanitise() none. Entities are joined by a hash of kind and value, so values of any length
are handled alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import checkpoint, hex_sha256, sliced, table

KINDS = ("email", "ip", "card", "phone")
#: Terms and entities above the threshold that are broadcast at most; beyond that they are joined.
BROADCAST_PAIRS = 100_000
#: Terms that a task counts before it gives their numbers on: all that are sent.
HELD_TERMS = BROADCAST_PAIRS
#: Texts with copies whose numbers are broadcast at most: 16 bytes each.
BROADCAST_COPIES = 500_000

# The patterns are those of the contract; what is added only spares retries that can't match: a run of digits or of
# local-part characters is entered at its start alone.
_local = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_not_local = re.compile(r"[^A-Za-z0-9._%+-]")
_ip = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_card = re.compile(r"[0-9](?:[ -]?[0-9])+")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_word = re.compile(r"\w+")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches. The local part ends at an @ and can't hold one, so each @ is looked at once:
    back to the start of its run (or the end of the last match), then on to the domain."""
    out, last, at = [], 0, text.find("@")
    before = 0  # where the search back from this @ ends: the last @ or the last match
    while at >= 0:
        start = at
        low = max(last, before)
        while start > low:
            step = max(low, start - 64)
            part = text[step:start]
            m = _local.search(part)
            if not m:
                break
            start = step + m.start()
            if m.start():
                break
        if start < at and (m := _domain.match(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
        before = at + 1
        at = text.find("@", max(at + 1, last))
    return out


def hashed(kind: str, value: str) -> int:
    return int.from_bytes(blake2b(f"{kind}:{value.lower()}".encode(), digest_size=8).digest(), "big", signed=True)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then kind."""
    if not text:
        return []
    out = []
    if "@" in text:
        out += [(a, b, 0) for a, b in emails(text)]
    for m in _card.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), 2))
    if "." in text:
        out += [(m.start(), m.end(), 1) for m in _ip.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split("."))]
    if "+" in text:
        for m in _phone.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((m.start(), m.end(), 3))
    out.sort(key=lambda x: (x[0], x[2]))
    return [(a, b, KINDS[k]) for a, b, k in out]


def entities_of(kind: str, value: str) -> list[int]:
    """The value and its classes, as hashes."""
    domain = [hashed("domain", value.rpartition("@")[2])] if kind == "email" else []
    return [hashed(kind, value), *domain, hashed("kind", kind)]


def blanked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with blanks in the place of all spans."""
    out, at = [], 0
    for a, b, _ in spans:
        out += [text[at:a], " " * (b - max(a, at))]
        at = max(at, b)
    return "".join([*out, text[at:]])


def terms_beside(text: str, a: int, b: int, reach: int) -> tuple[list[str], list[str]]:
    """The ``reach`` words before and after a span, lower-cased; the text is read outwards as far as needed only."""
    step = 16 * reach
    while True:  # one word more is read, so that those taken are whole
        left = [m[0] for m in _word.finditer(text[max(0, a - step) : a])]
        right = [m[0] for m in _word.finditer(text[b : b + step])]
        if (len(left) > reach or a <= step) and (len(right) > reach or b + step >= len(text)):
            break
        step *= 2
    return [w.lower() for w in left[-reach:]], [w.lower() for w in right[:reach]]


def contexts(df: DataFrame, text_col: str = "text", reach: int = 8) -> DataFrame:
    """(entity, context, copy, terms) for the entities of every base span of every text; entity, context and copy, the
    text, are hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            entity, context, copy, terms = [], [], [], []
            for text, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans = base_spans(text)
                plain = blanked(text, spans) if spans else ""
                for a, b, kind in spans:
                    left, right = terms_beside(plain, a, b, reach)
                    own = [t for t in {*left, *right} if any(map(str.isalpha, t))]
                    for e in entities_of(kind, text[a:b]):
                        entity.append(e)
                        context.append(hashed(" ".join(left), " ".join(right)))
                        copy.append(h)
                        terms.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(entity, pa.int64()), pa.array(context, pa.int64()), pa.array(copy, pa.int64()), pa.array(terms, pa.list_(pa.string()))], ["entity", "context", "copy", "terms"])

    return df.select(text_col, F.xxhash64(text_col)).mapInArrow(run, "entity long, context long, copy long, terms array<string>")


def document_frequency(df: DataFrame, terms: DataFrame, copies: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, n): distinct texts with each of the given terms. ``copies`` has (copy, rows) of the texts that more than one
    row has; each of their rows counts as its part of one text. Each task counts its own documents' terms before the
    shuffle, so a term that was sent is a row from each task, whatever the number of batches. Few terms are sent to the tasks, more are joined."""
    few = terms.count() <= BROADCAST_PAIRS
    sent = df.sparkSession.sparkContext.broadcast(frozenset(r.term for r in terms.collect()) if few else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, n = sent.value, {}
        told = lambda: pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.float64())], ["term", "n"])
        for batch in sliced(batches):
            for text, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = 1 / rows if rows else 1.0
                own = set(_word.findall(text.lower())) if text else set()
                for t in own if wanted is None else own & wanted:
                    n[t] = n.get(t, 0.0) + part
            if len(n) > HELD_TERMS:
                yield told()
                n.clear()
        yield told()

    copies = copies.hint("broadcast") if copies.count() <= BROADCAST_COPIES else copies
    rows = df.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("copy")).join(copies, "copy", "left").select("text", "rows")
    counts = rows.mapInArrow(run, "term string, n double")
    return (counts if few else counts.join(terms, "term", "left_semi")).groupBy("term").agg(F.round(F.sum("n")).cast("long").alias("n"))


def disclosing(df: DataFrame, text_col: str = "text", reach: int = 8, threshold: float = 0.5, support: int = 2) -> DataFrame:
    """(entity, term, disclosure) at or above the threshold, checkpointed."""
    seen = checkpoint(contexts(df, text_col, reach).groupBy("entity", "context", "copy").agg(F.first("terms").alias("terms")))
    wordings = F.count_distinct("context") >= support
    entities = seen.groupBy("entity").agg(F.count_distinct("copy").alias("n_e"), wordings.alias("enough")).where("enough").drop("enough")
    # few entities have the wordings; the terms of the others needn't be counted
    terms = seen.join(entities.select("entity"), "entity", "left_semi").select("entity", "context", "copy", F.explode("terms").alias("term"))
    pairs = terms.groupBy("entity", "term").agg(F.count_distinct("copy").alias("n_te"), wordings.alias("enough")).where("enough").drop("enough")
    pairs = checkpoint(pairs.join(entities, "entity"))
    if pairs.isEmpty():  # no term has the support: there is nothing to weigh
        return pairs.select("entity", "term", F.lit(0.0).alias("disclosure"))
    texts = checkpoint(df.groupBy(F.xxhash64(text_col).alias("copy")).agg(F.count(F.lit(1)).alias("rows")))
    n = F.lit(float(texts.count()))
    scored = pairs.join(document_frequency(df, pairs.select("term").distinct(), texts.where("rows > 1"), text_col), "term")
    # an entity of every text is no news and has no information to give away
    info = F.log(n / F.col("n_e"))
    pmi = F.log(F.col("n_te") * n / (F.greatest("n", "n_te") * F.col("n_e")))
    return checkpoint(scored.select("entity", "term", F.when(info > 0, pmi / info).otherwise(0.0).alias("disclosure")).where(F.col("disclosure") >= threshold))


def _spans(text: str | None, of: dict[int, set[str]]) -> list[tuple[int, int, str]]:
    """Base spans, and the words of the text that give away an entity of the same text and lie outside them."""
    spans = base_spans(text)
    if not spans or not of:
        return spans
    words = {t for a, b, k in spans for e in entities_of(k, text[a:b]) for t in of.get(e, ())}
    if not words:
        return spans
    covered = sorted((a, b) for a, b, _ in spans)
    low = text.lower()
    if len(low) != len(text):  # a few letters grow when lower-cased; places must be those of the text
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    extra, k = [], 0
    for m in _word.finditer(low):
        while k < len(covered) and covered[k][1] <= m.start():
            k += 1
        if m[0] in words and not (k < len(covered) and covered[k][0] < m.end()):
            extra.append((m.start(), m.end(), "term"))
    return sorted(spans + extra, key=lambda x: (x[0], (*KINDS, "term").index(x[2])))


def _of(own: list[dict]) -> dict[int, set[str]]:
    of: dict[int, set[str]] = {}
    for x in own:
        of.setdefault(x["entity"], set()).add(x["term"])
    return of


def _free(name: str, df: DataFrame) -> str:
    """The name, made longer until no column has it."""
    have = {c.lower() for c in df.columns}
    while name in have:
        name += "_"
    return name


def _with_own_pairs(df: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows and, last, the pairs of entity and term that the row itself has, for any number of pairs. Only rows with
    entities give their words, and a list holds no more than a row's own words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keys, entity, term = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                entities = {e for a, b, k in base_spans(text) for e in entities_of(k, text[a:b])}
                for t in set(_word.findall(text.lower())) if entities else ():
                    for e in entities:
                        keys.append(key), entity.append(e), term.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(entity, pa.int64()), pa.array(term, pa.string())], ["key", "entity", "term"])

    rows = df.select(F.xxhash64(id_col, text_col).alias("key"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
    pairs = rows.select("key", F.col("row").getField(text_col).alias("text")).mapInArrow(run, "key long, entity long, term string")
    own = pairs.join(found.select("entity", "term"), ["entity", "term"]).groupBy("key").agg(F.collect_set(F.struct("entity", "term")).alias("own"))
    rows = rows.join(own, "key", "left")
    return rows.select(*(F.col("row").getField(c).alias(c) for c in df.columns), F.col("own").alias(_free("own", df)))


def redact(text: str | None, spans: list[tuple[int, int, str]], remove: bool = False) -> str | None:
    """The text with each span generalised to its kind, or taken out. Overlapping spans fall together under the first."""
    if not spans:
        return text
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], "" if remove else f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def sanitise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 8, threshold: float = 0.5, support: int = 2, remove: bool = False, with_text: bool = True) -> DataFrame:
    """(id, spans array<struct<start, end, kind>>, text): base spans and disclosing terms, and the text without them."""
    found = disclosing(df, text_col, reach, threshold, support)
    kind_of_id = df.schema[id_col].dataType
    span = "array<struct<start:int,end:int,kind:string>>"
    schema = T.StructType([T.StructField(id_col, kind_of_id), T.StructField("spans", T._parse_datatype_string(span))] + [T.StructField("text", T.StringType())] * with_text)
    arrow_span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    few = found.count() <= BROADCAST_PAIRS
    pairs: dict[int, set[str]] = {}
    if few:
        for r in found.collect():
            pairs.setdefault(r.entity, set()).add(r.term)
        rows = df.select(F.col(id_col), F.col(text_col), F.array().cast("array<struct<entity:bigint,term:string>>"))
    else:
        rows = _with_own_pairs(df.select(id_col, text_col), found, id_col, text_col)
    sent = df.sparkSession.sparkContext.broadcast(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            spans, texts = [], []
            for text, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                spans.append(_spans(text, _of(own) if own else sent.value))
                if with_text:
                    texts.append(redact(text, spans[-1], remove))
            lists = pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in x] for x in spans], arrow_span)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists] + [pa.array(texts, pa.string())] * with_text, schema.names)

    return rows.mapInArrow(run, schema)


def sanitised(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows with all their columns and the text sanitised. Rows that repeat an id each get their own text."""
    found = disclosing(df, text_col, **options)
    at = df.columns.index(text_col)
    pairs: dict[int, set[str]] = {}
    rows, given = df, False
    if found.count() <= BROADCAST_PAIRS:
        for r in found.collect():
            pairs.setdefault(r.entity, set()).add(r.term)
    else:
        rows, given = _with_own_pairs(df, found, id_col, text_col), True
    sent = df.sparkSession.sparkContext.broadcast(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            owns = batch.column(batch.num_columns - 1).to_pylist() if given else [None] * batch.num_rows
            texts = []
            for text, own in zip(batch.column(at).to_pylist(), owns):
                texts.append(redact(text, _spans(text, _of(own) if own else sent.value)))
            columns = batch.columns[: len(df_names)]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, df_names)

    df_names = df.columns
    return rows.mapInArrow(run, df.schema)


def op1_sanitise(spark, sf_dir: str) -> DataFrame:
    out = sanitise(table(spark, sf_dir, "documents"), with_text=False)
    told = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"] != "term")
    kinds = F.transform("spans", lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, hex_sha256(told(base)).alias("base_sha256"), told(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_terms"))
