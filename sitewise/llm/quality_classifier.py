"""Quality classifier: hierarchical empirical Bayes over document, path and host.

Evidence of a document is the log likelihood ratio of seven binned measures of
its text (naive Bayes fitted on labelled documents). Each host's share of good
documents is shrunk toward the global share, and each path's toward its host's,
by a strength that the spread between hosts, and between paths of a host, gives
(method of moments). A document's own vote is left out of its site's shares.
The score is the evidence added to the log odds of its path.

Defined cases
* null or word-less text: all measures are 0; it is scored like any other.
* null host or path: a host or path of its own, named by the empty string.
* a source without a path (``site``): its sections stand for paths; without a section it is one path, shrunk to its host.
* null labels are not learned from; several labels of one document each count.
* no labels, or one class only: the evidence is 0 and the global share is one half or that of the smoothed counts.
* null id: scored, never labelled; repeated rows each get a row.
* an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.llm.common import documents, stored

SPACE = r"[\x20\x09-\x0D]+"
MEASURES, BINS = 7, 16
#: Naive Bayes counts measures that hang together as if apart; their sum is weighed down by this.
TEMPER = 0.5
#: Sites up to this number are broadcast (a few MB); beyond it each site's documents are dealt to so many tasks.
BROADCAST_SITES, SALTS = 50_000, 64
#: Bounds of the strength of shrinking, in documents.
WEAKEST, STRONGEST = 1.0, 1000.0


def _without(text: Column, marks: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, marks, ""))).cast("bigint")


def binned(text: Column) -> Column:
    """Seven measures, each in 0..15: integers all the way, so any engine agrees."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    from_words = F.get(
        F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("bigint").alias("n"), F.size(F.array_distinct(w)).cast("bigint").alias("d"))), 0
    )
    base = F.struct(
        from_words.alias("w"), F.length(F.regexp_replace(text, SPACE, "")).cast("bigint").alias("c"),
        _without(text, "#*$%&|<>").alias("s"), _without(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("u"),
        _without(text, ".,;:!?").alias("p"), _without(text, "0123456789").alias("g"),
    )

    def bins(b: Column) -> Column:
        n, c = F.greatest(b["w"]["n"], F.lit(1)), F.greatest(b["c"], F.lit(1))

        def share(x: Column, of: Column) -> Column:
            return F.least(F.lit(BINS - 1).cast("bigint"), F.floor(F.try_divide(x, of)).cast("bigint"))

        return F.array(
            share(40 * b["s"], c), share(16 * b["u"], c), share(15 * b["w"]["d"], n), share(b["c"], n),
            F.least(F.lit(BINS - 1), F.length(F.bin(b["w"]["n"] + 1))).cast("bigint"), share(16 * b["p"], c), share(100 * b["g"], c),
        )

    return F.get(F.transform(F.array(base), bins), 0)


def likelihood_ratios(features: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> tuple[list[float], float]:
    """(log ratios, MEASURES x BINS of them; log odds of a good label), smoothed by one half."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("bigint").alias("_good"))
    joined = features.join(known, "doc_id").select("_good", F.posexplode("_bins").alias("_m", "_b"))
    # At most MEASURES x BINS rows, whatever the input.
    counted = joined.groupBy("_m", "_b").agg(F.sum("_good").alias("good"), F.sum(1 - F.col("_good")).alias("bad")).collect()
    import math

    good, bad = [0.5] * (MEASURES * BINS), [0.5] * (MEASURES * BINS)
    for r in counted:
        good[r["_m"] * BINS + r["_b"]] += r["good"]
        bad[r["_m"] * BINS + r["_b"]] += r["bad"]
    ratios: list[float] = []
    for m in range(MEASURES):
        g, b = good[m * BINS : (m + 1) * BINS], bad[m * BINS : (m + 1) * BINS]
        ratios += [math.log(x / sum(g)) - math.log(y / sum(b)) for x, y in zip(g, b, strict=True)]
    first = [r for r in counted if r["_m"] == 0]
    n_good, n_bad = sum(r["good"] for r in first), sum(r["bad"] for r in first)
    return ratios, math.log((n_good + 0.5) / (n_bad + 0.5))


def strength(sites: DataFrame, within: str | None) -> float:
    """Documents' worth of the prior: how little the shares of sites differ beyond chance.

    sites: (_good, _n) and, if ``within`` is given, the share each is shrunk to.
    """
    mean = F.sum("_good") / F.sum("_n") if within is None else None
    if within is None:
        total = sites.agg(mean.alias("m")).collect()[0]["m"]
        if total is None:
            return STRONGEST
        prior = F.lit(float(total))
    else:
        prior = F.col(within)
    share = F.col("_good") / F.col("_n")
    got = sites.agg(
        F.sum(F.col("_n") * F.pow(share - prior, 2)).alias("spread"), F.sum(prior * (1 - prior)).alias("chance"),
        F.sum(F.col("_n") * prior * (1 - prior)).alias("whole"), F.sum("_n").alias("n"),
    ).collect()[0]
    if not got["n"]:
        return STRONGEST
    between = max((got["spread"] - got["chance"]) / got["n"], 1e-12)
    return float(min(STRONGEST, max(WEAKEST, got["whole"] / got["n"] / between - 1)))


def _odds(p: Column) -> Column:
    return F.log(p) - F.log(1 - p)


def _beside(voted: DataFrame, sites: DataFrame) -> DataFrame:
    """The documents with the figures of their sites: broadcast if those are few, else joined with each site dealt to many tasks."""
    sites = stored(sites)
    if sites.count() <= BROADCAST_SITES:
        return voted.join(F.broadcast(sites), ["_host", "_path"])
    salt = F.pmod(F.xxhash64("doc_id", "evidence"), F.lit(SALTS)).cast("int")
    return voted.withColumn("_salt", salt).join(sites.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["_host", "_path", "_salt"])


def classify_quality(
    docs: DataFrame, labels: DataFrame, *, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> DataFrame:
    """A row for each document: doc_id, evidence, host_share, path_share, score, kept."""
    features = stored(
        docs.select(
            F.col(id_col).alias("doc_id"), F.coalesce(host, F.lit("")).alias("_host"), F.coalesce(path, F.lit("")).alias("_path"),
            binned(F.coalesce(F.col(text_col), F.lit(""))).alias("_bins"),
        )
    )
    ratios, base = likelihood_ratios(features, labels, id_col, label_col)
    table = F.array(*[F.lit(x) for x in ratios])  # a constant of 112 numbers
    evidence = F.lit(TEMPER) * F.aggregate(
        F.transform("_bins", lambda b, i: F.get(table, (i * BINS + b).cast("int"))), F.lit(0.0), lambda a, x: a + x
    )
    voted = features.select("doc_id", "_host", "_path", evidence.alias("evidence")).withColumn("_vote", 1 / (1 + F.exp(-(F.col("evidence") + base))))
    paths = stored(voted.groupBy("_host", "_path").agg(F.sum("_vote").alias("_good"), F.count(F.lit(1)).alias("_n")))
    hosts = paths.groupBy("_host").agg(F.sum("_good").alias("_good"), F.sum("_n").alias("_n"))
    overall = hosts.agg((F.sum("_good") / F.sum("_n")).alias("m")).collect()[0]["m"]
    overall = 0.5 if overall is None else float(overall)
    by_host = strength(hosts, None)
    shrunk = hosts.select("_host", F.col("_good").alias("_host_good"), F.col("_n").alias("_host_n"))
    sites = paths.join(shrunk, "_host").withColumn("_prior", (F.col("_host_good") + by_host * overall) / (F.col("_host_n") + by_host))
    by_path = strength(sites, "_prior")
    own = F.col("_vote")
    host_share = (F.col("_host_good") - own + by_host * overall) / (F.col("_host_n") - 1 + by_host)
    path_share = (F.col("_good") - own + by_path * F.col("host_share")) / (F.col("_n") - 1 + by_path)
    joined = _beside(voted, sites).withColumn("host_share", host_share).withColumn("path_share", path_share)
    safe = F.least(F.greatest(F.col("path_share"), F.lit(1e-6)), F.lit(1 - 1e-6))
    scored = joined.withColumn("score", 1 / (1 + F.exp(-(F.col("evidence") + _odds(safe)))))
    six = [F.round(c, 6).alias(c) for c in ("evidence", "host_share", "path_share", "score")]
    return scored.select("doc_id", *six, (F.round("score", 6) >= 0.5).alias("kept"))


def site(source: Column, section: Column) -> tuple[Column, Column]:
    """(host, path) of a source ``host/path``; the documents of a source without a path are told apart by their section."""
    at = F.instr(source, "/")
    return F.when(at > 0, F.substring_index(source, "/", 1)).otherwise(source), F.when(at > 0, F.substring(source, at + 1, F.length(source))).otherwise(section)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Sources of these tables name no path: the section is the language.
    host, path = site(F.col("source"), F.col("lang"))
    return classify_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), host=host, path=path)


_COUNT = "length(t) - length(translate(t, '{}', ''))"
ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(split_part(source, '/', 1), '') AS host,
         coalesce(CASE WHEN strpos(source, '/') > 0 THEN substr(source, strpos(source, '/') + 1) ELSE lang END, '') AS path, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS c FROM d
), f AS (
  SELECT doc_id, host, path, [
    least(15, 40 * ({_COUNT.format('#*$%&|<>')}) // greatest(c, 1)),
    least(15, 16 * ({_COUNT.format('ABCDEFGHIJKLMNOPQRSTUVWXYZ')}) // greatest(c, 1)),
    least(15, 15 * len(list_distinct(ws)) // greatest(len(ws), 1)),
    least(15, c // greatest(len(ws), 1)),
    least(15, length(bin(len(ws) + 1))),
    least(15, 16 * ({_COUNT.format('.,;:!?')}) // greatest(c, 1)),
    least(15, 100 * ({_COUNT.format('0123456789')}) // greatest(c, 1))] AS bins
  FROM w
), x AS (
  SELECT m, bins[m] AS b, quality FROM (SELECT f.bins, l.quality, unnest(range(1, 8)) AS m FROM f JOIN labels l USING (doc_id) WHERE l.quality IN (0, 1))
), grid AS (
  SELECT m, b FROM range(1, 8) a(m), range(0, 16) z(b)
), k AS (
  SELECT grid.m, grid.b, 0.5::DOUBLE + count(*) FILTER (quality = 1) AS g, 0.5::DOUBLE + count(*) FILTER (quality = 0) AS h
  FROM grid LEFT JOIN x ON x.m = grid.m AND x.b = grid.b GROUP BY grid.m, grid.b
), r AS (
  SELECT m, b, ln(g / sum(g) OVER (PARTITION BY m)) - ln(h / sum(h) OVER (PARTITION BY m)) AS lr FROM k
), base AS (
  SELECT ln((count(*) FILTER (quality = 1) + 0.5::DOUBLE) / (count(*) FILTER (quality = 0) + 0.5::DOUBLE)) AS o FROM x WHERE m = 1
), fr AS (
  SELECT row_number() OVER () AS id, * FROM f
), ev AS (
  SELECT id, {TEMPER}::DOUBLE * sum(lr) AS evidence FROM (SELECT id, bins[m] AS b, m FROM (SELECT id, bins, unnest(range(1, 8)) AS m FROM fr)) JOIN r USING (m, b) GROUP BY id
), v AS (
  SELECT fr.doc_id, host, path, evidence, 1 / (1 + exp(-(evidence + o))) AS vote FROM fr JOIN ev USING (id), base
), p AS (
  SELECT host, path, sum(vote) AS pg, count(*) AS pn FROM v GROUP BY ALL
), h AS (
  SELECT host, sum(pg) AS hg, sum(pn) AS hn FROM p GROUP BY host
), a AS (
  SELECT sum(hg) / sum(hn) AS m FROM h
), sh AS (
  SELECT least({STRONGEST}, greatest({WEAKEST}, sum(hn * m * (1 - m)) / sum(hn) / greatest((sum(hn * (hg / hn - m) ** 2) - sum(m * (1 - m))) / sum(hn), 1e-12) - 1)) AS kh FROM h, a
), s AS (
  SELECT p.*, hg, hn, (hg + kh * m) / (hn + kh) AS prior FROM p JOIN h USING (host), a, sh
), sp AS (
  SELECT least({STRONGEST}, greatest({WEAKEST}, sum(pn * prior * (1 - prior)) / sum(pn) / greatest((sum(pn * (pg / pn - prior) ** 2) - sum(prior * (1 - prior))) / sum(pn), 1e-12) - 1)) AS kp FROM s
), q AS (
  SELECT v.doc_id, evidence, vote, pg, pn, (hg - vote + kh * m) / (hn - 1 + kh) AS hs, kp FROM v JOIN s USING (host, path), a, sh, sp
), z AS (
  SELECT doc_id, evidence, hs, (pg - vote + kp * hs) / (pn - 1 + kp) AS ps FROM q
), o AS (
  SELECT *, least(greatest(ps, 1e-6), 1 - 1e-6) AS safe FROM z
)
SELECT doc_id, round(evidence, 6) AS evidence, round(hs, 6) AS host_share, round(ps, 6) AS path_share,
       round(1 / (1 + exp(-(evidence + ln(safe) - ln(1 - safe)))), 6) AS score,
       round(1 / (1 + exp(-(evidence + ln(safe) - ln(1 - safe)))), 6) >= 0.5 AS kept
FROM o
"""
