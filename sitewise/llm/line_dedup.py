"""Line dedup by an exact set-similarity join, in built-in functions only.

A line is the set of its words. Equal sets are one class, named by their first
line in order of (document id, line number); class numbers follow that order.
Words are ordered by rarity: a table of corpus counts, by hashed word, ranks
them; ties go by hash, so the order is total. Two sets of Jaccard similarity 0.8
share a word of their prefixes (a fifth of the set and one) under any one order;
the join pairs classes by prefix words under a length, a positional and a
parity-bitmap bound, and each pair is verified on the whole 64-bit hashes of all
words. A line is removed if an earlier line matches it.

A link is a pair of classes that match. ``line_links`` has them all, and the result counts
them for each line; with the class of each line they say every pair of similar
lines. Classes are dealt by prefix word and paired by word and size: a class lies with its
own group of sizes and is held against the groups of its bounds, three at most, so a row
for each class and prefix word is all that is shuffled. A word in the prefixes of more
than ``BLOCK`` classes is dealt by its groups of sizes too, so no task has all of it.
The links are the same for every ``HOT`` and ``BLOCK``.

A pair is verified in the cell (a shared prefix word and group of sizes) where it was
found: a class's whole set goes once to each cell that needs it, not once to each pair.

Where only the removed lines are asked for (``drop_similar_lines``), the lines of hot words
are first held against a few of the earliest lines of each; only lines which that
doesn't settle are joined with all earlier ones. So a large group of near copies
costs a row a line there, not a row a pair.

Defined cases
* null text, and lines without a word: no result rows; such lines are never removed.
* null id: its lines have no place in the order; they are kept and remove nothing.
* rows of one id and text are one document; texts of one id are ordered by their hash.
* ties: of equal lines the first in order stays; a document's own repeats count like others'.
* words compare lower-cased; sets are named by 128 bits of their words' hashes.
* an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.llm.common import configured, documents, forget, stored
from sitewise.llm.quality_rules import let

SPACE = r"[\x20\x09-\x0D]+"
#: Buckets of the table of word counts, one byte each: half a MB.
BUCKETS, PAGE = 1 << 19, 8192
#: A word in the prefixes of more classes than HOT has pivots; one in more than BLOCK (at least HOT) is dealt by sizes.
HOT, BLOCK = 128, 4096
#: Rows of a task of a join by words: some 30 MB that it hashes.
TASK_ROWS = 200_000
#: Classes of a hot word that all others of the word are first held against.
PIVOTS = 3
#: Numbers of 64 bits in the set of classes that pre-selects lines; more classes make it select less, never wrongly.
CHOSEN = 1 << 16
#: Sets of so many words have a bitmap of 256 bits, smaller ones of 64.
WIDE = 80
#: Tables of up to so many rows are broadcast, larger ones shuffled.
BROADCAST = 100_000

#: A filter on what is exploded would make two shuffles of the one that both sides of a join share.
_NO_FILTER = "org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate"

#: Partitions of up to so much shuffled data are hashed in a join.
SMALL = "64m"

_PLACE = ("_id", "_text", "_line")


def _words(line: Column) -> Column:
    """White-space separated words; a line whose only white space is blanks needs no pattern."""
    return F.array_remove(F.when(line.rlike(r"[\t\x0B\f\r]"), F.split(line, SPACE)).otherwise(F.split(line, " ")), "")


def _bit(x: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), x.bitwiseAND(63).cast("int"))


def line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(place, n, _a, _b, words) of every line that has a word: the sorted hashes of its different words, and the set's name of 128 bits."""
    named = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    whole = named.select(F.col(id_col).cast("bigint").alias("_id"), F.xxhash64(text_col).alias("_text"), F.posexplode(F.split(F.lower(text_col), "\n")).alias("_line", "_whole"))
    hashes = F.sort_array(F.array_distinct(F.transform(_words(F.col("_whole")), lambda w: F.xxhash64(w))))
    sets = whole.where(F.col("_whole").rlike(r"[^\x20\x09-\x0D]")).select(*_PLACE, hashes.alias("words"))
    # Words repeat: a large dictionary holds a file's different hashes once.
    return stored(
        sets.select(*_PLACE, F.size("words").alias("n"), F.xxhash64("words").alias("_a"), F.xxhash64(F.lit(1), "words").alias("_b"), "words"),
        **{"parquet.dictionary.page.size": str(8 << 20)},
    )


def _bucket(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - (BUCKETS - 1).bit_length()).cast("int")


def rank_table(lines: DataFrame) -> DataFrame:
    """One row, an array of a rank for each bucket: half doublings of the count of its words over all lines. Its length is a parameter, whatever the input."""
    seen = lines.select(F.explode("words").alias("h")).groupBy(_bucket(F.col("h")).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    every = seen.unionByName(lines.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b"), F.lit(0).cast("bigint").alias("n"))).groupBy("b").agg(F.sum("n").alias("n"))
    rank = F.least(F.lit(63), F.floor(2 * F.log2(F.col("n") + 1))).cast("tinyint")
    pages = every.groupBy((F.col("b") / PAGE).cast("int").alias("p")).agg(F.sort_array(F.collect_list(F.struct("b", rank.alias("v")))).alias("x"))
    pages = pages.select(F.struct("p", F.transform("x", lambda x: x["v"]).alias("v")).alias("x"))
    return stored(pages.agg(F.flatten(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["v"])).alias("ranks")))


def class_table(lines: DataFrame) -> DataFrame:
    """A row for each different set of words: number, name, place of its first line, size, prefix words with how many of them are surely not hot, bitmap."""
    table = rank_table(lines)
    # A scalar subquery: tasks hold the one array and no row carries it.
    ranked = lines.withColumn("ranks", table.scalar())

    def keyed_by(ranks: Column) -> Column:
        return F.sort_array(F.transform("words", lambda h: F.shiftleft(F.get(ranks, _bucket(h)).cast("bigint"), 57).bitwiseOR(F.shiftrightunsigned(h, 7))))

    keys = let(F.col("ranks"), keyed_by)

    def parity(words: Column) -> Column:
        return F.aggregate(words, F.lit(0).cast("bigint"), lambda a, h: a.bitwiseXOR(_bit(h)))

    def quarter(k: int) -> Column:
        wide = parity(F.filter("words", lambda h: F.shiftrightunsigned(h, 6).bitwiseAND(3) == k))
        return F.when(F.col("n") >= WIDE, wide).otherwise(parity(F.col("words")) if k == 0 else F.lit(0).cast("bigint")).alias(f"b{k}")

    prefix = F.slice("keys", 1, F.col("n") - F.floor((4 * F.col("n") + 4) / 5).cast("int") + 1)
    keyed = ranked.select("_a", "_b", *_PLACE, "n", *map(quarter, range(4)), keys.alias("keys"))
    # A word is at most as frequent as its bucket.
    least_hot = int(2 * (HOT + 1).bit_length() - 2)
    described = keyed.select(
        "_a", "_b", *_PLACE, "n", F.size(F.filter(prefix, lambda k: F.shiftrightunsigned(k, 57) < least_hot)).alias("cold"), *(f"b{k}" for k in range(4)),
        F.transform(prefix, lambda k: k.bitwiseAND(0x7FFFFFFF).cast("int")).alias("prefix"),
    )
    row = ("n", "cold", *(f"b{k}" for k in range(4)), "prefix")
    classes = described.groupBy("_a", "_b").agg(F.min(F.struct(*_PLACE, *row)).alias("f")).select("_a", "_b", "f.*")
    made = stored(classes.orderBy(*_PLACE).select(F.monotonically_increasing_id().alias("c"), "_a", "_b", *_PLACE, *row))
    forget(table)
    return made


def _bounds(x: str, y: str) -> Column:
    """Length, positional and bitmap filters on a pair that shares a prefix word, its first common one.

    Sets of n and m words are similar if 9 times their symmetric difference is at most n + m.
    """
    narrow = " ^ ".join(f"{s}.b{k}" for s in (x, y) for k in range(4))
    wide = " + ".join(f"bit_count({x}.b{k} ^ {y}.b{k})" for k in range(4))
    return F.expr(f"""
        5 * least({x}.n, {y}.n) >= 4 * greatest({x}.n, {y}.n)
        and 9 * ({x}.pos + {y}.pos + abs(({x}.n - {x}.pos) - ({y}.n - {y}.pos))) <= {x}.n + {y}.n
        and 9 * bit_count({narrow}) <= {x}.n + {y}.n
        and ({x}.n < {WIDE} or {y}.n < {WIDE} or 9 * ({wide}) <= {x}.n + {y}.n)
    """)


def _sized(table: DataFrame) -> DataFrame:
    """The table, to be broadcast if it is small."""
    return F.broadcast(table) if table.count() <= BROADCAST else table


def _postings(classes: DataFrame, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows of words in at most so many classes, rows of the other words with the number k of their classes, those words): a row for each class and prefix word.

    Sets of fewer than four words match equal ones only.
    """
    sets = classes.where("n >= 4").select("c", "n", "cold", "b0", "b1", "b2", "b3", "prefix")
    index = sets.select("*", F.posexplode("prefix").alias("pos", "word")).drop("prefix")
    crowded = stored(index.where("pos >= cold").groupBy("word").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > most))
    words = _sized(crowded)
    return index.drop("cold").join(words, "word", "left_anti"), index.where("pos >= cold").drop("cold").join(words, "word"), crowded


def _pairs(later: DataFrame, earlier: DataFrame, *on: str) -> DataFrame:
    """(a, b, cell): later and earlier classes that pass the filters."""
    same = F.lit(True)
    for name in on:
        same &= F.col(f"x.{name}") == F.col(f"y.{name}")
    cell = F.xxhash64(*(F.col(f"x.{name}") for name in on)).alias("cell")
    return later.alias("x").join(earlier.alias("y"), same & (F.col("x.c") > F.col("y.c")) & _bounds("x", "y")).select(F.col("x.c").alias("a"), F.col("y.c").alias("b"), cell)


def _sizes(n: str) -> Column:
    """The group of a size; from one to the next sizes grow by a quarter."""
    # Never null, so that a join adds no filter below it.
    return F.coalesce(F.floor(F.log(1.25, F.expr(n))).cast("int"), F.lit(0))


def _sized_pairs(later: DataFrame, earlier: DataFrame) -> DataFrame:
    """Pairs of a word and of sizes that may match: each pair meets once, in the later one's group."""
    bounds = F.sequence(_sizes("ceil(4 * n / 5)"), _sizes("floor(5 * n / 4)"))
    return _pairs(later.withColumn("g", _sizes("n")), earlier.withColumn("g", F.explode(bounds)), "word", "g")


def _word_pairs(later: DataFrame, earlier: DataFrame, rows: int) -> DataFrame:
    """Pairs under words of at most BLOCK classes: rows are dealt by word, and go to groups of sizes inside the task."""
    tasks = max(int(later.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    return _sized_pairs(later.repartition(tasks, "word").hint("shuffle_hash"), earlier.repartition(tasks, "word"))


def _joined(pairs: DataFrame) -> DataFrame:
    """The stored different pairs, each with one cell. Where all partitions of a join are small it hashes one side instead of sorting both."""
    # Rows dealt by word need no other shuffle to be joined by word and size.
    settings = {"spark__sql__adaptive__maxShuffledHashJoinLocalMapThreshold": SMALL, "spark__sql__requireAllClusterKeysForCoPartition": "false", "spark__sql__optimizer__excludedRules": _NO_FILTER}
    with configured(pairs.sparkSession, **settings):
        return stored(pairs.groupBy("a", "b").agg(F.min("cell").alias("cell")))


def _verified(pairs: DataFrame, lines: DataFrame, classes: DataFrame) -> DataFrame:
    """The stored pairs that are similar on their whole sets."""
    sides = pairs.select("cell", F.explode(F.array("a", "b")).alias("c")).distinct()
    wanted = stored(sides.select("c").distinct().join(classes.select("c", "_a", *_PLACE), "c"))
    chosen = wanted.groupBy(F.pmod("_a", F.lit(CHOSEN)).cast("int").alias("p")).agg(F.bit_or(_bit(F.shiftright("_a", 32))).alias("v"))
    # At most CHOSEN rows.
    spot = F.pmod("_a", F.lit(CHOSEN)).cast("int")
    maybe = lines.withColumn("p", spot).join(F.broadcast(chosen), "p").where(F.col("v").bitwiseAND(_bit(F.shiftright("_a", 32))) != 0)
    # Repeated rows have one place.
    sets = maybe.select(*_PLACE, "words").join(wanted.drop("_a"), list(_PLACE)).groupBy("c").agg(F.first("words").alias("words"))
    sets = stored(sides.join(sets, "c"))
    dealt = sets.repartition("cell").hint("shuffle_hash")
    overlap = F.size(F.array_intersect("x.words", "y.words"))
    n = F.size("x.words") + F.size("y.words")
    both = (
        pairs.repartition("cell").alias("p")
        .join(dealt.alias("x"), (F.col("p.cell") == F.col("x.cell")) & (F.col("p.a") == F.col("x.c")))
        .join(dealt.alias("y"), (F.col("p.cell") == F.col("y.cell")) & (F.col("p.b") == F.col("y.c")))
    )
    # All three are dealt by cell: the joins need no other shuffle.
    with configured(lines.sparkSession, spark__sql__requireAllClusterKeysForCoPartition="false"):
        found = stored(both.where(9 * overlap >= 4 * n).select("a", "b"))
    forget(wanted, sets)
    return found


def _rows(classes: DataFrame) -> int:
    """Prefix words of all classes together, or a few more."""
    return classes.agg(F.sum(F.expr("n div 5 + 1"))).first()[0] or 0


def _all_links(lines: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b), a > b: every pair of classes that match."""
    rest, hot, crowded = _postings(classes, BLOCK)
    pairs = _joined(_word_pairs(rest, rest, _rows(classes)).unionByName(_sized_pairs(hot, hot)))
    found = _verified(pairs, lines, classes)
    forget(pairs, crowded)
    return found


def _tables(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    lines = line_table(docs, id_col, text_col)
    return lines, class_table(lines)


def line_links(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every pair of different sets of words that match, by their first lines: doc_id, line, match_doc_id, match_line; the match is earlier."""
    lines, classes = _tables(docs, id_col, text_col)
    links = _all_links(lines, classes)
    forget(lines)
    for c in ("a", "b"):
        links = links.join(classes.select(F.col("c").alias(c), F.struct("_id", "_line").alias(f"_{c}")), c)
    return links.select(F.col("_a._id").alias("doc_id"), F.col("_a._line").alias("line"), F.col("_b._id").alias("match_doc_id"), F.col("_b._line").alias("match_line"))


def _with_links(lines: DataFrame, classes: DataFrame) -> DataFrame:
    """(c, _links, _least): the classes that match each, and the first of them."""
    links = _all_links(lines, classes)
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("b").alias("o")), F.struct(F.col("b").alias("c"), F.col("a").alias("o")))).alias("e")).select("e.*")
    found = stored(ends.groupBy("c").agg(F.count(F.lit(1)).alias("_links"), F.min("o").alias("_least")))
    forget(links)
    return found


def _with_some_match(lines: DataFrame, classes: DataFrame) -> DataFrame:
    """(c): the classes that match some class before them."""
    cold, hot, crowded = _postings(classes, HOT)
    rows = _rows(classes)
    # The earliest classes of each hot word, of so many parts of its classes, against all others of the word.
    part = F.pmod(F.xxhash64("c"), F.lit(PIVOTS))
    pivots = hot.groupBy("word", part.alias("part")).agg(F.min(F.struct("c", "n", "b0", "b1", "b2", "b3", "pos")).alias("f")).select("word", "f.*")
    first = _joined(_word_pairs(cold, cold, rows).unionByName(_pairs(hot, pivots, "word")))
    settled = _verified(first, lines, classes)
    left = hot.join(settled.select(F.col("a").alias("c")).distinct(), "c", "left_anti")
    most = F.col("k") > BLOCK
    more = _word_pairs(left.where(~most), hot.where(~most), rows).unionByName(_sized_pairs(left.where(most), hot.where(most)))
    rest = _joined(more.join(first, ["a", "b"], "left_anti"))
    more = _verified(rest, lines, classes)
    found = stored(settled.unionByName(more).select(F.col("a").alias("c")).distinct())
    forget(first, rest, settled, more, crowded)
    return found


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each line with a word: doc_id, line (from 0), n_words (distinct), class_doc_id and class_line
    (first line of the same set), n_links (other sets that match), match_doc_id and match_line (the first line
    before it that it matches, if any, as first line of its set), removed."""
    lines, classes = _tables(docs, id_col, text_col)
    found = _with_links(lines, classes)
    own = F.struct(*_PLACE)
    earlier = found.where("_least < c").join(classes.select(F.col("c").alias("_least"), own.alias("_match")), "_least").select("c", "_match")
    judged = classes.select("c", "_a", "_b", own.alias("_first")).join(found.select("c", "_links"), "c", "left").join(earlier, "c", "left").drop("c")
    match = F.when(own == F.col("_first"), F.col("_match")).otherwise(F.coalesce("_match", F.col("_first")))
    placed = lines.select(*_PLACE, "n", "_a", "_b").join(judged, ["_a", "_b"]).withColumn("_m", match)
    return placed.select(
        F.col("_id").alias("doc_id"), F.col("_line").alias("line"), F.col("n").alias("n_words"),
        F.col("_first._id").alias("class_doc_id"), F.col("_first._line").alias("class_line"), F.coalesce("_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.col("_m._id").alias("match_doc_id"), F.col("_m._line").alias("match_line"), F.col("_m").isNotNull().alias("removed"),
    )


def drop_similar_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all their columns, without the lines that an earlier line matches; those left without a word go.

    The row rides in one struct, so its columns may have any names.
    """
    lines, classes = _tables(docs, id_col, text_col)
    matched = _with_some_match(lines, classes)
    judged = classes.select("c", "_a", "_b", F.struct(*_PLACE).alias("_first")).join(matched.withColumn("_again", F.lit(True)), "c", "left")
    placed = lines.select(*_PLACE, "_a", "_b").join(judged, ["_a", "_b"])
    bad = stored(placed.where("_again or struct(_id, _text, _line) <> _first").groupBy("_id", "_text").agg(F.collect_set("_line").alias("_bad")))
    forget(lines, classes, matched)
    text = F.col("_row").getField(text_col)
    packed = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("_id"), F.xxhash64(text_col).alias("_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("_bad", i)), "\n")
    cut = packed.join(bad, ["_id", "_text"], "left").withColumn("_new", F.when(F.col("_bad").isNull(), text).otherwise(kept))
    cut = cut.where(F.col("_bad").isNull() | F.col("_new").rlike(r"[^\x20\x09-\x0D]"))
    return cut.select(*[(F.col("_new") if c == text_col else F.col("_row").getField(c)).alias(c) for c in docs.columns])


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir))
