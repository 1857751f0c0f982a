"""Quality rules with cross-document line frequency, in DataFrame functions only.

A line is normalised (lower case, runs of digits to one 0, runs of white space to one space, trimmed) and hashed. Each
host's lines are counted by the number of documents that hold them. A line in more than ``share`` of its host's
documents, and in more than ``min_documents``, goes; a document is depleted, and rejected, when less than ``min_share``
of its words or fewer than ``min_words`` words stay. ``n_removed_chars`` tells the characters, as they stand in the text,
of the lines that go; it isn't judged by. ``without_frequent_lines`` gives the texts without them.

Cases: a null or empty text has no words and fails the base rules; a null host is a host of its own; a line repeated
within a document counts once for it, while all its occurrences go; lines without a word are neither counted nor taken
out; rows that repeat with the same id, host and text are documents of their own (each counts, each gets a row); other
columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, table

#: The characters between words, and those that count as symbols.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Frequent lines, and hosts, that are broadcast at most: 24 bytes or so each.
BROADCAST_LINES = 200_000
BETWEEN = "[ \\x09-\\x0D]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BETWEEN), "")


def with_words(lines: Column) -> Column:
    return F.filter(lines, lambda x: x.rlike("[^ \\x09-\\x0D]"))


def raw_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def normalised_lines(text: Column) -> Column:
    """The lines of a text, in the order of raw_lines(), normalised over the text as a whole."""
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[ \\t\\x0B\\f\\r]{2,}|[\\t\\x0B\\f\\r]", " ")
    return F.transform(F.split(F.regexp_replace(spaced, "[0-9]+", "0"), "\n"), lambda x: F.trim(x))


def n_words_of(line: Column) -> Column:
    """Words of a normalised line, which has one space between two words and none outside."""
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def repeated_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """Adds the number of words inside windows of WINDOW words that the text has twice or more.

    Windows are hashed; only where some hash is double are they sorted with their places, and the places of the
    doubles give the words covered: the sum of the steps between them, each WINDOW at most, and WINDOW for the last."""
    df = df.withColumn("_h", F.transform(words, lambda w: F.xxhash64(w)))
    windows = F.transform(F.sequence(F.lit(1), F.size("_h") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_h", i, WINDOW)))
    df = df.withColumn("_w", F.when(F.size("_h") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    placed = F.sort_array(F.transform("_w", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_w")) < F.size("_w"), placed))
    same = F.zip_with(F.slice("_s", 2, F.greatest(F.size("_s"), F.lit(1))), F.col("_s"), lambda b, a: F.when(b.h == a.h, F.array(a.i, b.i)))
    places = F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))
    df = df.withColumn("_p", places)
    zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    step = lambda acc, p: F.struct((acc.n + F.least(F.lit(WINDOW), p - acc.last)).alias("n"), p.alias("last"))
    return df.withColumn(out, F.coalesce(F.aggregate("_p", zero, step, lambda acc: acc.n), F.lit(0)).cast("long")).drop("_h", "_w", "_s", "_p")


def base_rules(df: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to rows with ``text``."""
    text = F.coalesce("text", F.lit(""))
    lines = with_words(F.split(text, "\n"))
    df = df.withColumn("_words", words_of(text)).withColumn("_lines", lines)
    df = df.withColumn("word_chars", F.length(F.translate(text, SPACES, "")).cast("long"))
    df = df.withColumn("n_symbols", F.col("word_chars") - F.length(F.translate(text, SPACES + SYMBOLS, "")))
    df = df.withColumn("n_words", F.size("_words").cast("long"))
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    df = repeated_words(df, "_words", "n_repeat_words").drop("_words", "_lines")
    return df.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def frequent_lines(docs: DataFrame, share: float, min_documents: int) -> DataFrame:
    """(_host, _line), written: hashes of the lines above the limit, for (text, host). A document gives each line once,
    so counts need no distinct and are summed in part before the shuffle, which also evens out hot hosts and lines."""
    lines = docs.select("host", F.explode(F.array_distinct(F.transform(F.filter(normalised_lines(F.col("text")), lambda x: x != ""), lambda x: F.xxhash64(x)))).alias("line"))
    counts = checkpoint(lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("documents")).where(F.col("documents") > min_documents))
    sizes = checkpoint(docs.groupBy(F.col("host").alias("_host")).agg(F.count(F.lit(1)).alias("size")))
    sizes = sizes.hint("broadcast") if sizes.count() <= BROADCAST_LINES else sizes
    over = counts.join(sizes, counts.host.eqNullSafe(F.col("_host"))).where(F.col("documents") > share * F.col("size"))
    return checkpoint(over.select("_host", F.col("line").alias("_line")))


def _sent(frequent: DataFrame) -> DataFrame:
    """Sent to all tasks only up to a number; beyond it a sort-merge join splits hot lines."""
    return frequent.hint("broadcast" if frequent.count() <= BROADCAST_LINES else "merge")


def _named(df: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(host_col).cast("string").alias("host"))
    return docs.withColumn("key", F.xxhash64("id", "text", "host"))


def _removed(docs: DataFrame, frequent: DataFrame) -> DataFrame:
    """(key, id, host, place, line, chars, words) of each line that goes, as often as rows repeat."""
    each = F.zip_with(raw_lines(F.col("text")), normalised_lines(F.col("text")), lambda r, x: F.struct(F.xxhash64(x).alias("line"), F.length(r).alias("chars"), n_words_of(x).alias("words"), (x != "").alias("some")))
    lines = docs.select("key", "id", "host", F.posexplode(each).alias("place", "l")).where("l.some").select("key", "id", "host", "place", "l.line", "l.chars", "l.words")
    return lines.join(_sent(frequent), lines.host.eqNullSafe(F.col("_host")) & (lines.line == F.col("_line"))).drop("_host", "_line")


def line_quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", share: float = 0.01, min_documents: int = 10, min_share: float = 0.5, min_words: int = 20) -> DataFrame:
    """(id, the base counts, base_failed, n_removed_chars, kept) for each row."""
    docs = _named(df, id_col, text_col, host_col)
    base = base_rules(docs).drop("text")
    shown = [c for c in base.columns if c not in ("key", "id", "host")]
    removed = _removed(docs, frequent_lines(docs, share, min_documents)).groupBy("key", "id")
    # rows that repeat give the same places each
    removed = removed.agg(F.sum("chars").alias("chars"), F.sum("words").alias("words"), (F.count(F.lit(1)) / F.count_distinct("place")).alias("rows"))
    removed = removed.select(F.col("key").alias("_key"), F.col("id").alias("_id"), (F.col("chars") / F.col("rows")).cast("long").alias("_chars"), (F.col("words") / F.col("rows")).cast("long").alias("_gone"))
    out = base.join(removed, (F.col("key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id")), "left")
    left = F.col("n_words") - F.coalesce("_gone", F.lit(0))
    depleted = (left < min_words) | (left < min_share * F.col("n_words"))
    out = out.withColumn("n_removed_chars", F.coalesce("_chars", F.lit(0).cast("long"))).withColumn("kept", ~F.col("base_failed") & ~depleted)
    return out.select(F.col("id").alias(id_col), *shown, "n_removed_chars", "kept")


def without_frequent_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", share: float = 0.01, min_documents: int = 10) -> DataFrame:
    """(id, text) for each row: the text without its frequent lines, as it is where it has none."""
    docs = _named(df, id_col, text_col, host_col)
    gone = _removed(docs, frequent_lines(docs, share, min_documents)).groupBy("key", "id").agg(F.collect_set("line").alias("gone"))
    gone = gone.select(F.col("key").alias("_key"), F.col("id").alias("_id"), "gone")
    out = docs.join(gone, (F.col("key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id")), "left")
    stays = F.zip_with(raw_lines(F.col("text")), normalised_lines(F.col("text")), lambda r, x: F.when((x == "") | ~F.array_contains("gone", F.xxhash64(x)), r))
    return out.select(F.col("id").alias(id_col), F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(stays, "\n")).alias(text_col))


def op8_line_frequency(spark, sf_dir: str) -> DataFrame:
    out = line_quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_chars")


#: The same rows, with lines and windows as they are instead of their hashes.
OP8_SQL = r"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
i AS (SELECT row, w, unnest(range(1, greatest(len(w) - 7, 0) + 1)) AS i FROM w),
k AS (SELECT row, i, count(*) OVER (PARTITION BY row, array_to_string(w[i:i + 7], ' ')) AS n FROM i),
r AS (SELECT row, count(DISTINCT j) AS n FROM (SELECT row, unnest(range(i, i + 8)) AS j FROM k WHERE n > 1) GROUP BY 1),
l AS (SELECT row, host, unnest(string_split(text, chr(10))) AS line FROM d),
m AS (SELECT row, host, line, trim(regexp_replace(regexp_replace(lower(line), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g'), ' ') AS norm FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
s AS (SELECT host, count(*) AS n FROM d GROUP BY 1), c AS (SELECT host, norm, count(DISTINCT row) AS n FROM m GROUP BY 1, 2),
f AS (SELECT c.host, norm FROM c JOIN s ON c.host IS NOT DISTINCT FROM s.host WHERE c.n > 10 AND c.n > 0.01 * s.n),
g AS (SELECT row, sum(length(line)) AS chars, sum(len(string_split(m.norm, ' '))) AS words FROM m JOIN f ON m.host IS NOT DISTINCT FROM f.host AND m.norm = f.norm GROUP BY 1),
u AS (SELECT row, count(*) - count(DISTINCT line) AS n FROM m GROUP BY 1),
b AS (SELECT d.row, doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
CAST(coalesce(u.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, coalesce(g.words, 0) AS gone, CAST(coalesce(g.chars, 0) AS BIGINT) AS n_removed_chars
FROM d JOIN w USING (row) LEFT JOIN u USING (row) LEFT JOIN r USING (row) LEFT JOIN g USING (row))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - gone >= 20 AND 2 * (n_words - gone) >= n_words AS kept, n_removed_chars FROM b"""
