"""Quality rules: per-text measures and cross-document line frequency, all in built-in functions.

A line that stands in more than ``line_limit_pct`` per cent of the documents of its host, and in
more than ``line_least`` of them, is boilerplate there and is removed; a document left with less
than ``min_left_pct`` per cent of the characters of its different lines is depleted and rejected.
The share makes the rule the same for hosts of every size; copies of a document that are
fewer than that share of their host don't make each other's lines frequent.

Defined cases
* null or blank text: no words, so ``base_failed`` is true and ``kept`` false.
* null host: those documents form one host of their own.
* rows of one id are one document of their host; rows without an id are told apart by their text.
* repeated rows (also of one id) each get their own result row.
* other columns of the input are ignored; clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.llm.common import documents, stored

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: A line in a larger share of its host's documents, in per cent, and in more documents than the second number is boilerplate.
LINE_LIMIT_PCT, LINE_LEAST = 10, 5
#: A document that keeps a smaller share of its line characters is rejected.
MIN_LEFT_PCT = 30
#: Hosts with frequent lines up to this number are broadcast; beyond it each host's documents are dealt to so many tasks.
BROADCAST_HOSTS, SALTS = 20_000, 64
#: Up to this many repeated windows a linear look-up is cheaper than a sort.
FEW = 32


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def word_lines_of(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, SPACE, " ")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once: a lambda over an array of one."""
    return F.get(F.transform(F.array(value), body), 0)


def _windows(words: Column) -> Column:
    n = F.size(words)
    return F.when(
        n >= 3,
        F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))


def _repeated(windows: Column) -> Column:
    """Distinct hashes that occur twice or more: neighbours in sorted order."""
    return let(F.sort_array(windows), lambda s: F.array_distinct(F.filter(s, lambda h, i: (i > 0) & (F.get(s, i - 1) == h))))


def _covered(starts: Column) -> Column:
    """Words under three-word windows that begin at these ascending places."""
    def summed(s: Column) -> Column:
        gaps = F.transform(s, lambda x, i: F.coalesce(F.least(F.get(s, i + 1) - x, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, g: a + g)

    return let(starts, summed)


def _neighbours(placed: Column) -> Column:
    """Places of the (hash, place) pairs whose hash stands next to an equal one."""
    def same(x: Column, i: Column) -> Column:
        before = (i > 0) & (F.get(placed, i - 1)["h"] == x["h"])
        return before | F.coalesce(F.get(placed, i + 1)["h"] == x["h"], F.lit(False))

    return F.sort_array(F.transform(F.filter(placed, same), lambda x: x["i"]))


def repeat_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more; a linear look-up or a sort, by how many repeat."""
    def counted(windows: Column) -> Column:
        def by(again: Column) -> Column:
            few = F.filter(F.transform(windows, lambda h, i: F.when(F.array_contains(again, h), i)), lambda i: i.isNotNull())
            placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
            return (
                F.when(F.size(again) == 0, F.lit(0).cast("bigint"))
                .when(F.size(again) <= FEW, _covered(few))
                .otherwise(_covered(let(placed, _neighbours)))
            )

        return let(_repeated(windows), by)

    return let(_windows(words), counted)


def measures(docs: DataFrame, id_col: str, text_col: str, *others: Column) -> DataFrame:
    """The text measures of each row; ``others`` pass through."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    from_words = let(words_of(text), lambda w: F.struct(F.size(w).cast("bigint").alias("n"), repeat_words(w).alias("again")))
    dup_lines = let(word_lines_of(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))
    return docs.select(
        F.col(id_col).alias("doc_id"), *others, from_words.alias("_w"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        dup_lines.alias("n_dup_lines"),
    ).withColumns({"n_words": F.col("_w.n"), "n_repeat_words": F.col("_w.again")}).drop("_w")


def _host(host_col: str) -> Column:
    return F.coalesce(F.xxhash64(F.col(host_col)), F.lit(0))


def _distinct_lines(text: Column) -> Column:
    return F.array_distinct(F.transform(word_lines_of(text), normalised))


def frequent_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", line_limit_pct: int = LINE_LIMIT_PCT, line_least: int = LINE_LEAST,
) -> DataFrame:
    """(_host, _often): the hashes of each host's boilerplate lines, for hosts that have any.

    Hosts, documents and lines are 64-bit hashes: only those cross the network, and a
    line's documents are counted before they meet. A host has at most 100 / line_limit_pct times as
    many such lines as its documents have lines on average.
    """
    own = docs.select(_host(host_col).alias("_host"), F.coalesce(F.xxhash64(id_col), F.xxhash64(text_col)).alias("_doc"), F.col(text_col).alias("_text"))
    of_host = own.groupBy("_host").agg(F.count_distinct("_doc").alias("_docs"))
    seen = own.select("_host", "_doc", F.explode(F.transform(_distinct_lines(F.col("_text")), lambda x: F.xxhash64(x))).alias("_line")).distinct()
    counts = seen.groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > line_least)
    often = counts.join(of_host, "_host").where(100 * F.col("_n") > line_limit_pct * F.col("_docs"))
    return often.groupBy("_host").agg(F.collect_list("_line").alias("_often"))


def _beside(docs: DataFrame, often: DataFrame) -> DataFrame:
    """The documents with their host's ``_often``: broadcast to them if the table is small, else joined with each host dealt to many tasks."""
    if often.count() <= BROADCAST_HOSTS:
        return docs.join(F.broadcast(often), "_host", "left")
    salted = docs.withColumn("_salt", F.pmod("_key", F.lit(SALTS)).cast("int"))
    return salted.join(often.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["_host", "_salt"], "left").drop("_salt")


def quality_rules(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    min_words: int = 50, max_repeat_pct: int = 50, line_limit_pct: int = LINE_LIMIT_PCT, line_least: int = LINE_LEAST, min_left_pct: int = MIN_LEFT_PCT,
    keep_columns: bool = False,
) -> DataFrame:
    """A row for each document with its measures, ``base_failed`` and ``kept``.

    keep_columns: returns the input's own columns of the kept rows instead, their texts without frequent lines.
    """
    often = stored(frequent_lines(docs, id_col=id_col, text_col=text_col, host_col=host_col, line_limit_pct=line_limit_pct, line_least=line_least))
    own = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if keep_columns else []
    rows = docs.select(_host(host_col).alias("_host"), F.xxhash64(id_col, text_col).alias("_key"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), *own)

    def left(lines: Column) -> Column:
        gone = F.filter(lines, lambda x: F.array_contains("_often", F.xxhash64(x)))
        return F.struct(*(F.aggregate(x, F.lit(0).cast("bigint"), lambda a, y: a + F.length(y)).alias(n) for x, n in ((lines, "chars"), (gone, "gone"))))

    with_often = _beside(rows, often).withColumn("_often", F.coalesce("_often", F.array().cast("array<bigint>")))
    judged = measures(with_often, "doc_id", "_text", let(_distinct_lines(F.coalesce("_text", F.lit(""))), left).alias("_lines"), "_often", "_text", *(["_row"] if keep_columns else []))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    judged = judged.withColumn("base_failed", failed)
    judged = judged.withColumn("kept", ~F.col("base_failed") & (100 * (F.col("_lines.chars") - F.col("_lines.gone")) >= min_left_pct * F.col("_lines.chars")))
    if keep_columns:
        lines = F.filter(F.split("_text", "\n"), lambda x: ~F.array_contains("_often", F.xxhash64(normalised(x))))
        cut = F.when(F.col("_lines.gone") == 0, F.col("_text")).otherwise(F.array_join(lines, "\n"))
        return judged.where("kept").select(*[(cut if c == text_col else F.col("_row").getField(c)).alias(c) for c in docs.columns])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents
), w AS (
  SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM d
), m AS (
  SELECT r, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         list_distinct(list_transform(ls, lambda x: lower(trim(regexp_replace(x, '[\\x20\\x09-\\x0D]+', ' ', 'g'))))) AS nl
  FROM w
), g AS (
  SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS tri
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
), again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, tri) AS c FROM g) WHERE c > 1
), rep AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r
), lines AS (
  SELECT r, d.host, coalesce(CAST(d.doc_id AS VARCHAR), md5(d.text)) AS doc, x.line FROM d JOIN (SELECT r, unnest(nl) AS line FROM m) x USING (r)
), hosts AS (
  SELECT host, count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), md5(text))) AS docs FROM d GROUP BY host
), often AS (
  SELECT host, line FROM (SELECT host, line, count(DISTINCT doc) AS n FROM lines GROUP BY ALL) JOIN hosts USING (host)
  WHERE n > {LINE_LEAST} AND 100 * n > {LINE_LIMIT_PCT} * docs
), lost AS (
  SELECT r, sum(length(line)) AS n FROM lines JOIN often USING (host, line) GROUP BY r
), j AS (
  SELECT d.doc_id, m.n_words, m.word_chars,
         CAST(length(d.text) - length(translate(d.text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
         m.n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
         coalesce(list_sum(list_transform(m.nl, lambda x: length(x))), 0) AS chars, coalesce(lost.n, 0) AS lost
  FROM d JOIN m USING (r) LEFT JOIN rep USING (r) LEFT JOIN lost USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND 100 * (chars - lost) >= {MIN_LEFT_PCT} * chars AS kept
FROM j
"""


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))
