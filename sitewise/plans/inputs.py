"""Domain tables made from the driver's star schema, by integer arithmetic that any engine repeats.

``SQL`` has the same tables as DuckDB expressions, to be put before an oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.functions.geo import haversine_m, mercator_x, mercator_y, minutes, square
from sitewise.operators.grid import Grid, build_grid
from sitewise.operators.pois import flatten
from sitewise.operators.spatial import count_facilities, population_per_cell

GRID = Grid((37.55, 55.72, 37.65, 55.78), 500)
HALF_M = 200.0
#: A box in projected metres: west, south, east, north.
METRIC_BOX = (4_183_000.25, 7_504_500.25, 4_185_500.25, 7_507_000.25)
SQL_IN_BOX = "x + {h} >= {} AND y + {h} >= {} AND x - {h} <= {} AND y - {h} <= {}".format(*METRIC_BOX, h=HALF_M)
EXCLUDED_TAGS = ("laboratory", "rehabilitation")
EXCLUDED_NAMES = ("эстет", "дентал")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _coordinate(key: str, factor: int, modulus: int, origin: float, scale: float) -> Column:
    return origin + (F.col(key) * factor % modulus) / F.lit(scale)


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response elements: nodes, ways with a centre and ways without."""
    k = F.col("c_custkey")
    lon, lat = _coordinate("c_custkey", 7919, 1000, 37.55, 9500.0), _coordinate("c_custkey", 104729, 997, 55.72, 16000.0)
    node = k % 4 != 0
    amenity = (
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", "clinic").when(F.col("c_mktsegment") == "BUILDING", "hospital")
        .when(F.col("c_mktsegment") == "FURNITURE", "doctors").when(F.col("c_mktsegment") == "MACHINERY", "veterinary")
    )
    care = F.when(F.col("c_nationkey") % 5 == 0, "laboratory").when(F.col("c_nationkey") % 5 == 2, "clinic").when(F.col("c_nationkey") % 5 == 3, "rehabilitation")
    name = F.when(k % 7 == 0, F.concat(F.lit("ЭСТЕТ "), k.cast("string"))).when(k % 7 == 1, F.lit(None)).otherwise(F.col("c_name"))
    tags = F.map_filter(F.create_map(F.lit("name"), name, F.lit("amenity"), amenity, F.lit("healthcare"), care), lambda _, v: v.isNotNull())
    return _table(spark, sf_dir, "customer").select(
        F.when(node, "node").otherwise("way").alias("type"), k.alias("id"), F.when(node, lat).alias("lat"), F.when(node, lon).alias("lon"),
        F.when(~node & (k % 12 != 0), F.struct(lat.alias("lat"), lon.alias("lon"))).alias("center"), tags.alias("tags"),
    )


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten(elements(spark, sf_dir))


def hexagons(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = _coordinate("o_orderkey", 6007, 1009, 37.55, 10000.0), _coordinate("o_orderkey", 7001, 991, 55.72, 16500.0)
    ring = square(mercator_x(lon), mercator_y(lat), HALF_M)
    return _table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("population"), ring.alias("ring"))


def squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same squares by their edges: o_orderkey, population, x0, y0, x1, y1."""
    corners = hexagons(spark, sf_dir)
    low, high = F.get("ring", 0), F.get("ring", 2)
    return corners.select("o_orderkey", "population", low["x"].alias("x0"), low["y"].alias("y0"), high["x"].alias("x1"), high["y"].alias("y1"))


def estimates(cells: DataFrame) -> DataFrame:
    """cell_id, wealth_score, area_character: some null."""
    n = F.col("row") * GRID.columns + F.col("col")
    area = F.when(n % 7 == 0, "industrial").when(n % 9 == 1, F.lit(None)).otherwise("residential")
    return cells.select("cell_id", F.when(n % 13 != 0, n * 7 % 11).cast("int").alias("wealth_score"), area.alias("area_character"))


def siting_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with population, existing_clinics and estimates."""
    counted = population_per_cell(count_facilities(build_grid(spark, GRID), facilities(spark, sf_dir), GRID), hexagons(spark, sf_dir), GRID)
    return counted.join(estimates(build_grid(spark, GRID)), "cell_id", "left")


def network(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes at all customers' places, and roads both ways from each order's customer to another one, by the straight way at three quarters of the speed."""
    customers = _table(spark, sf_dir, "customer")
    nodes = customers.select(
        F.col("c_custkey").alias("node"), _coordinate("c_custkey", 7919, 1000, 37.55, 9500.0).alias("lon"), _coordinate("c_custkey", 104729, 997, 55.72, 16000.0).alias("lat")
    )
    most = customers.agg(F.max("c_custkey").alias("most"))
    pairs = _table(spark, sf_dir, "orders").crossJoin(F.broadcast(most)).select(
        F.col("o_custkey").alias("a"), (1 + (F.col("o_orderkey") * 31 + F.col("o_custkey") * 17) % F.col("most")).alias("b")
    )

    def at(side: str) -> DataFrame:
        return nodes.select(F.col("node").alias(side), F.col("lon").alias(f"lon_{side}"), F.col("lat").alias(f"lat_{side}"))

    measured = pairs.join(at("a"), "a").join(at("b"), "b")
    way = minutes(haversine_m(F.col("lon_a"), F.col("lat_a"), F.col("lon_b"), F.col("lat_b"))) / 0.75
    roads = measured.select("a", "b", way.alias("minutes"))
    return nodes, roads.unionByName(roads.select(F.col("b").alias("a"), F.col("a").alias("b"), "minutes"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, raw: ten kinds of model replies, valid and not."""
    d = F.col("doc_id")
    wealth, confidence = (d % 11).cast("string"), ((d % 101) / F.lit(100.0)).cast("string")
    area = F.element_at(F.array(*[F.lit(x) for x in ("residential", "commercial", "industrial", "mixed")]), (d % 4 + 1).cast("int"))

    def made(w: Column, a: Column, rest: Column) -> Column:
        return F.concat(F.lit('{"wealth_score": '), w, F.lit(', "area_character": "'), a, F.lit('"'), rest, F.lit("}"))

    sure = F.concat(F.lit(', "confidence": '), confidence)
    plain = made(wealth, area, sure)
    raw = (
        F.when(d % 10 == 0, plain)
        .when(d % 10 == 1, F.concat(F.lit("```json\n"), plain, F.lit("\n```")))
        .when(d % 10 == 2, F.concat(F.lit("Вот ответ:\n"), plain, F.lit("\nКонец.")))
        .when(d % 10 == 3, made(F.concat(F.lit('"'), wealth, F.lit('"')), area, sure))
        .when(d % 10 == 4, made(F.concat(wealth, F.lit(".9")), area, sure))
        .when(d % 10 == 5, made(F.lit("true"), area, sure))
        .when(d % 10 == 6, made(F.lit('"7.5"'), area, sure))
        .when(d % 10 == 7, made(wealth, area, F.lit("")))
        .when(d % 10 == 8, F.concat(F.lit("не могу: "), wealth))
        .otherwise(made((d % 11 + 5).cast("string"), F.lit(" Mixed "), sure))
    )
    return _table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell_id, wealth_score, price_per_m2 of parts taken as cells."""
    n = F.col("p_partkey")
    return _table(spark, sf_dir, "part").select(
        F.format_string("cell_%06d", n).alias("cell_id"), F.when(n % 17 != 0, F.col("p_size")).cast("double").alias("wealth_score"), F.when(n % 19 != 0, F.col("p_retailprice")).alias("price_per_m2")
    )


def _double(x: float) -> str:
    return f"'{x!r}'::DOUBLE"


def sql_haversine(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return (
        f"(2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))))"
    )


def sql_minutes(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return f"({sql_haversine(lon1, lat1, lon2, lat2)} / 1000.0::DOUBLE / 25.0::DOUBLE * 60.0::DOUBLE)"


_LAT, _LON = _double(GRID.lat_step), _double(GRID.lon_step)
_Y = "(6378137.0::DOUBLE * ln(tan(pi() / 4 + radians({}) / 2)))"
_X = "(6378137.0::DOUBLE * radians({}))"

#: Common table expressions: cells, fac, located, counted, people, est, siting.
SQL = f"""
WITH RECURSIVE lats AS (
  SELECT 0 AS r, 55.72::DOUBLE AS y UNION ALL SELECT r + 1, y + {_LAT} FROM lats WHERE y + {_LAT} < 55.78::DOUBLE
), lons AS (
  SELECT 0 AS c, 37.55::DOUBLE AS x UNION ALL SELECT c + 1, x + {_LON} FROM lons WHERE x + {_LON} < 37.65::DOUBLE
), cells AS (
  SELECT r * (SELECT count(*) FROM lons) + c AS i, printf('cell_%06d', r * (SELECT count(*) FROM lons) + c) AS cell_id, r, c, x AS x0, y AS y0, x + {_LON} AS x1, y + {_LAT} AS y1,
         x + {_LON} / 2 AS center_lon, y + {_LAT} / 2 AS center_lat
  FROM lats, lons
), raw_fac AS (
  SELECT c_custkey AS osm_id, CASE WHEN c_custkey % 4 <> 0 THEN 'node' ELSE 'way' END AS osm_type,
         CASE WHEN c_custkey % 7 = 0 THEN 'ЭСТЕТ ' || c_custkey WHEN c_custkey % 7 = 1 THEN NULL ELSE c_name END AS name,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'clinic' WHEN 'BUILDING' THEN 'hospital' WHEN 'FURNITURE' THEN 'doctors' WHEN 'MACHINERY' THEN 'veterinary' END AS amenity,
         CASE c_nationkey % 5 WHEN 0 THEN 'laboratory' WHEN 2 THEN 'clinic' WHEN 3 THEN 'rehabilitation' END AS healthcare,
         37.55::DOUBLE + (c_custkey * 7919 % 1000)::DOUBLE / 9500.0::DOUBLE AS lon, 55.72::DOUBLE + (c_custkey * 104729 % 997)::DOUBLE / 16000.0::DOUBLE AS lat
  FROM customer
), fac AS (
  SELECT * FROM raw_fac WHERE osm_id % 12 <> 0
), located AS (
  SELECT fac.*, cell_id FROM fac JOIN cells ON lon > x0 AND lon < x1 AND lat > y0 AND lat < y1
), counted AS (
  SELECT cell_id, count(*) AS n FROM located GROUP BY cell_id
), squares AS (
  SELECT o_orderkey, o_totalprice / 1000 AS population, {_X.format('37.55::DOUBLE + (o_orderkey * 6007 % 1009)::DOUBLE / 10000.0::DOUBLE')} AS x, {_Y.format('(55.72::DOUBLE + (o_orderkey * 7001 % 991)::DOUBLE / 16500.0::DOUBLE)')} AS y
  FROM orders
), metric AS (
  SELECT cell_id, {_X.format('x0')} AS mx0, {_X.format('x1')} AS mx1, {_Y.format('y0')} AS my0, {_Y.format('y1')} AS my1 FROM cells
), people AS (
  SELECT cell_id, sum(population * (least(mx1, x + {HALF_M}) - greatest(mx0, x - {HALF_M})) * (least(my1, y + {HALF_M}) - greatest(my0, y - {HALF_M})) / ({4 * HALF_M * HALF_M}::DOUBLE)) AS p
  FROM squares JOIN metric ON mx1 > x - {HALF_M} AND mx0 < x + {HALF_M} AND my1 > y - {HALF_M} AND my0 < y + {HALF_M} GROUP BY cell_id
), est AS (
  SELECT cell_id, CASE WHEN i % 13 <> 0 THEN CAST(i * 7 % 11 AS INTEGER) END AS wealth_score,
         CASE WHEN i % 7 = 0 THEN 'industrial' WHEN i % 9 = 1 THEN NULL ELSE 'residential' END AS area_character
  FROM cells
), siting AS (
  SELECT cells.*, CAST(coalesce(n, 0) AS BIGINT) AS existing_clinics, CAST(round_even(coalesce(p, 0), 0) AS BIGINT) AS population, wealth_score, area_character
  FROM cells LEFT JOIN counted USING (cell_id) LEFT JOIN people USING (cell_id) LEFT JOIN est USING (cell_id)
)"""


def sql_scores(source: str, prefix: str = "") -> str:
    """Common table expressions {prefix}scored: equity and profit over all rows of a table."""
    def scaled(x: str, of: str) -> str:
        return f"CASE WHEN (SELECT max({x}) = min({x}) FROM {of}) THEN 0.0::DOUBLE ELSE ({x} - (SELECT min({x}) FROM {of})) / (SELECT max({x}) - min({x}) FROM {of}) END"

    p = prefix
    return f""", {p}base AS (
  SELECT *, population::DOUBLE AS pop, wealth_score::DOUBLE AS wealth, 1.0::DOUBLE / (1.0::DOUBLE + existing_clinics) AS scarce FROM {source}
), {p}parts AS (
  SELECT *, {scaled('pop', f'{p}base')} AS a, {scaled('wealth', f'{p}base')} AS b, {scaled('scarce', f'{p}base')} AS s FROM {p}base
), {p}products AS (
  SELECT *, a * s AS e0, a * b * s AS p0 FROM {p}parts
), {p}scored AS (
  SELECT *, {scaled('e0', f'{p}products')} AS equity, {scaled('p0', f'{p}products')} AS profit FROM {p}products
)"""
