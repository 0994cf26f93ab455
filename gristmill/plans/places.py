"""Places, names, groups and covers over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gristmill.functions import text
from gristmill.operators import blocks, fits, graph, joins, search, spatial
from gristmill.operators import places as guard
from gristmill.plans.registry import query
from gristmill.session import table

_POINTS = "SELECT c_custkey, -120 + (c_custkey * 37 % 5000) / 100.0::DOUBLE AS x, 25 + (c_custkey * 53 % 2400) / 100.0::DOUBLE AS y FROM customer"
#: A star of seven corners around a place of each nation.
_CORNERS = """SELECT n_nationkey AS ring, seq, -118 + (n_nationkey * 11 % 45) + (3 + 2 * (seq % 2)) * cos(2 * pi() * seq / 7) AS x,
    27 + (n_nationkey * 7 % 20) + (2 + 2 * (seq % 2)) * sin(2 * pi() * seq / 7) AS y FROM nation, (SELECT unnest(range(7)) AS seq)"""
_INSIDE = f"""WITH p AS ({_POINTS}), v AS ({_CORNERS}), s AS (SELECT a.ring, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS "by" FROM v a JOIN v b ON a.ring = b.ring AND b.seq = (a.seq + 1) % 7),
    i AS (SELECT c_custkey, ring FROM p JOIN s ON (ay > y) <> ("by" > y) WHERE x < (bx - ax) * (y - ay) / ("by" - ay) + ax GROUP BY 1, 2 HAVING count(*) % 2 = 1)"""


def _points(spark, d):
    key = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", (-120 + (key * 37 % 5000) / 100.0).alias("x"), (25 + (key * 53 % 2400) / 100.0).alias("y"))


def _corners(spark, d):
    n, k = F.col("n_nationkey"), F.col("seq")
    seqs = table(spark, d, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("seq"))
    angle = 2 * F.pi() * k / 7
    return seqs.select(n.alias("ring"), "seq", (-118 + (n * 11 % 45) + (3 + 2 * (k % 2)) * F.cos(angle)).alias("x"), (27 + (n * 7 % 20) + (2 + 2 * (k % 2)) * F.sin(angle)).alias("y"))


@query("point_in_polygon", f"{_INSIDE} SELECT c_custkey, ring FROM i")
def point_in_polygon(spark, d):
    return spatial.inside(_points(spark, d), _corners(spark, d), "ring", 2.0).select("c_custkey", "ring")


@query(
    "place_to_ring",
    f"""{_INSIDE}, c AS (SELECT ring, avg(x) AS cx, avg(y) AS cy FROM v GROUP BY 1), f AS (SELECT c_custkey, min(ring) AS held FROM i GROUP BY 1),
    n AS (SELECT p.c_custkey, arg_min(ring, (round(pow(x - cx, 2) + pow(y - cy, 2), 9), ring)) AS near, min(pow(x - cx, 2) + pow(y - cy, 2)) AS far FROM p, c GROUP BY 1)
    SELECT c.c_custkey, coalesce(held, CASE WHEN far <= 36 THEN near END, c_nationkey) AS ring, CASE WHEN held IS NOT NULL THEN 'inside' WHEN far <= 36 THEN 'near' ELSE 'code' END AS basis
    FROM customer c LEFT JOIN f USING (c_custkey) LEFT JOIN n USING (c_custkey)""",
)
def place_to_ring(spark, d):
    """The ring that holds a place, else the nearest centre within six degrees, else the place's own code; few rings, so their centres are one array."""
    points, corners = _points(spark, d), _corners(spark, d)
    held = spatial.inside(points, corners, "ring", 2.0).groupBy("c_custkey").agg(F.min("ring").alias("held"))
    centres = corners.groupBy("ring").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy")).agg(F.collect_list(F.struct("ring", "cx", "cy")).alias("centres"))
    far = F.array_min(F.transform("centres", lambda c: F.struct(F.round(F.pow(F.col("x") - c["cx"], 2) + F.pow(F.col("y") - c["cy"], 2), 9).alias("far"), c["ring"].alias("ring"))))
    near = points.join(centres, F.lit(True)).select("c_custkey", far.alias("n"))
    joined = table(spark, d, "customer").join(held, "c_custkey", "left").join(near, "c_custkey", "left")
    close = F.col("n.far") <= 36
    basis = F.when(F.col("held").isNotNull(), "inside").when(close, "near").otherwise("code")
    return joined.select("c_custkey", F.coalesce("held", F.when(close, F.col("n.ring")), "c_nationkey").alias("ring"), basis.alias("basis"))


@query(
    "code_join_precedence",
    """WITH k AS (SELECT n_nationkey AS code, n_regionkey AS target FROM nation WHERE n_nationkey % 3 <> 0), b AS (SELECT n_nationkey AS code, unnest([n_regionkey, n_regionkey + 10]) AS target FROM nation)
    SELECT c_custkey, k.target FROM customer JOIN k ON c_nationkey = k.code UNION ALL
    SELECT c_custkey, b.target FROM customer JOIN b ON c_nationkey = b.code WHERE c_nationkey NOT IN (SELECT code FROM k)""",
)
def code_join_precedence(spark, d):
    """A known code decides alone; an unknown one takes every target of the fallback list."""
    nation = table(spark, d, "nation")
    known = nation.where("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("c_nationkey"), F.array("n_regionkey").alias("own"))
    fallback = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.array("n_regionkey", F.col("n_regionkey") + 10).alias("other"))
    joined = table(spark, d, "customer").join(known, "c_nationkey", "left").join(fallback, "c_nationkey", "left")
    return joined.select("c_custkey", F.explode(F.coalesce("own", "other")).alias("target"))


_TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda t: t <> ''))"
_NEAR_WORD = "list_filter(l.w, lambda x: len(list_filter(r.w, lambda y: levenshtein(x, y) <= 1)) > 0)"


@query(
    "name_match_join",
    f"""WITH l AS (SELECT DISTINCT p_name AS listing, p_type AS block, {_TOKENS.format('p_name')} AS w FROM part WHERE p_size % 2 = 0),
    r AS (SELECT DISTINCT p_name AS record, p_type AS block, {_TOKENS.format('p_name')} AS w FROM part WHERE p_size % 2 = 1),
    s AS (SELECT listing, l.block, record, len({_NEAR_WORD}) AS shared, len(l.w) + len(r.w) AS whole FROM l JOIN r ON l.block = r.block),
    t AS (SELECT listing, block, record, round(shared / (whole - shared)::DOUBLE, 6) AS score FROM s WHERE shared > 0),
    b AS (SELECT *, rank() OVER (PARTITION BY listing, block ORDER BY score DESC) AS place FROM t WHERE score >= 0.3)
    SELECT listing, block, CASE WHEN count(*) = 1 THEN min(record) END AS record, max(score) AS score, CASE WHEN count(*) = 1 THEN 'matched' ELSE 'tied' END AS outcome FROM b WHERE place = 1 GROUP BY 1, 2""",
)
def name_match_join(spark, d):
    """The best record of a listing's block by the words they share, a letter's slack allowed; a tie matches none.

    Blocked by context and by a shared letter pair of a word, so that only
    names with a word in common but for one letter are compared.
    """
    parts = table(spark, d, "part")
    listings = parts.where("p_size % 2 = 0").select(F.col("p_name").alias("listing"), F.col("p_type").alias("block")).distinct()
    records = parts.where("p_size % 2 = 1").select(F.col("p_name").alias("record"), F.col("p_type").alias("block")).distinct()

    def keyed(df, name):
        """Deletion keys: two words within one edit share the word itself or one of its forms with a letter left out."""
        forms = F.flatten(F.transform(F.array_distinct(text.tokens(F.col(name))), lambda w: F.array_append(F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w)))), w)))
        return df.withColumn("key", F.explode(F.array_distinct(forms)))

    pairs = keyed(listings, "listing").join(keyed(records, "record"), ["block", "key"]).select("block", "listing", "record").distinct()
    scored = pairs.withColumn("score", F.round(text.name_similarity(F.col("listing"), F.col("record")), 6)).where("score >= 0.3")
    best = scored.groupBy("listing", "block").agg(F.max("score").alias("score"))
    top = scored.join(best, ["listing", "block", "score"]).groupBy("listing", "block", "score").agg(F.count("*").alias("n"), F.min("record").alias("record"))
    return top.select("listing", "block", F.when(F.col("n") == 1, F.col("record")).alias("record"), "score", F.when(F.col("n") == 1, "matched").otherwise("tied").alias("outcome"))


@query(
    "name_groups",
    """WITH RECURSIVE n AS (SELECT DISTINCT p_name AS name FROM part), e AS (SELECT a.name AS a, b.name AS b FROM n a JOIN n b ON a.name <> b.name AND levenshtein(a.name, b.name) <= 3),
    r(node, reached) AS (SELECT a, a FROM e UNION SELECT a, b FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.reached = e.a)
    SELECT node, min(reached) AS component FROM r GROUP BY 1""",
)
def name_groups(spark, d):
    """Names that chains of three edits join."""
    names = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    near = search.within_edits(names, "name", 3).select(F.col("name").alias("a"), F.col("other").alias("b"))
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(_shared(spark))
    return graph.components(near)


def _shared(spark) -> str:
    """The folder named for checkpoints; one on this machine only where all runs on it."""
    import tempfile

    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return named or tempfile.mkdtemp(prefix="gristmill-")


@query("greedy_cover")
def greedy_cover(spark, d):
    """The ten suppliers that one after another add most retail price of parts not covered yet."""
    pairs = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("family"), F.col("l_partkey").alias("element"))
    weights = table(spark, d, "part").select(F.col("p_partkey").alias("element"), F.col("p_retailprice").alias("weight"))
    chosen = graph.greedy_cover(pairs, weights, 10)
    return spark.createDataFrame([(k + 1, *c) for k, c in enumerate(chosen)], "step int, family long, gain double, elements long")


@query("nation_bounds", f"WITH p AS ({_POINTS}) SELECT c_nationkey, min(x) AS west, min(y) AS south, max(x) AS east, max(y) AS north FROM p JOIN customer USING (c_custkey) GROUP BY 1")
def nation_bounds(spark, d):
    placed = _points(spark, d).join(table(spark, d, "customer"), "c_custkey")
    return placed.groupBy("c_nationkey").agg(F.min("x").alias("west"), F.min("y").alias("south"), F.max("x").alias("east"), F.max("y").alias("north"))


@query(
    "albers_cells",
    f"""WITH k AS (SELECT (sin(radians(29.5)) + sin(radians(45.5))) / 2 AS n), c AS (SELECT n, pow(cos(radians(29.5)), 2) + 2 * n * sin(radians(29.5)) AS c FROM k),
    t AS (SELECT c_custkey, sqrt(c - 2 * n * sin(radians(y))) / n AS rho, sqrt(c - 2 * n * sin(radians(37.5))) / n AS rho0, n * radians(x + 96) AS theta FROM ({_POINTS}), c)
    SELECT c_custkey, round(rho * sin(theta), 6) AS px, round(rho0 - rho * cos(theta), 6) AS py, CAST(floor(rho * sin(theta) * 6371 / 40) AS BIGINT) AS i, CAST(floor((rho0 - rho * cos(theta)) * 6371 / 40) AS BIGINT) AS j FROM t""",
)
def albers_cells(spark, d):
    """Equal-area coordinates, and the cell of 40 km that holds a place."""
    px, py = spatial.albers(F.col("x"), F.col("y"))
    return _points(spark, d).select("c_custkey", F.round(px, 6).alias("px"), F.round(py, 6).alias("py"), F.floor(px * 6371 / 40).alias("i"), F.floor(py * 6371 / 40).alias("j"))


@query(
    "bilinear_heights",
    f"""WITH p AS (SELECT c_custkey, CAST(floor(x) AS BIGINT) AS i, CAST(floor(y) AS BIGINT) AS j, x - floor(x) AS fx, y - floor(y) AS fy FROM ({_POINTS})),
    z AS (SELECT *, (i * i + 3 * j + i * j) % 97 AS a, ((i + 1) * (i + 1) + 3 * j + (i + 1) * j) % 97 AS b, (i * i + 3 * (j + 1) + i * (j + 1)) % 97 AS c, ((i + 1) * (i + 1) + 3 * (j + 1) + (i + 1) * (j + 1)) % 97 AS e FROM p)
    SELECT c_custkey, round(a * (1 - fx) * (1 - fy) + b * fx * (1 - fy) + c * (1 - fx) * fy + e * fx * fy, 6) AS height FROM z""",
)
def bilinear_heights(spark, d):
    """Heights between the four grid values around a place: one join with each cell's corners."""
    i, j = F.floor("x"), F.floor("y")
    grid = spark.range(-130, -60).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(20).cast("long"), F.lit(59).cast("long"))).alias("j"))
    grid = grid.withColumn("z", ((F.col("i") * F.col("i") + 3 * F.col("j") + F.col("i") * F.col("j")) % 97).cast("double"))
    by_row = Window.partitionBy("j").orderBy("i")
    by_column = Window.partitionBy("i").orderBy("j")
    cells = grid.withColumn("z10", F.lead("z").over(by_row)).withColumn("z01", F.lead("z").over(by_column)).withColumn("z11", F.lead("z10").over(by_column))
    placed = _points(spark, d).withColumn("i", i).withColumn("j", j).join(cells, ["i", "j"])
    height = spatial.bilinear(F.col("z"), F.col("z10"), F.col("z01"), F.col("z11"), F.col("x") - F.col("i"), F.col("y") - F.col("j"))
    return placed.select("c_custkey", F.round(height, 6).alias("height"))


@query("membership_lists", f"{_INSIDE} SELECT ring, list(c_custkey ORDER BY c_custkey) AS members, count(*) AS n FROM i GROUP BY 1")
def membership_lists(spark, d):
    """The members of a ring in one list, which is put together from the ordered lists of each thousand of ids."""
    found = spatial.inside(_points(spark, d), _corners(spark, d), "ring", 2.0)
    listed = found.groupBy("ring", blocks.block_of(F.col("c_custkey"), 1000).alias("block")).agg(F.array_sort(F.collect_list("c_custkey")).alias("members"))
    whole = listed.groupBy("ring").agg(F.array_sort(F.collect_list(F.struct("block", "members"))).alias("blocks"))
    return whole.select("ring", F.flatten("blocks.members").alias("members")).withColumn("n", F.size("members").cast("long"))


@query(
    "target_expansion",
    """WITH t AS (SELECT s_suppkey, unnest([s_nationkey, (s_nationkey + 1) % 25]) AS nation FROM supplier)
    SELECT DISTINCT s_suppkey, c_custkey FROM (SELECT s_suppkey, c_custkey FROM t JOIN customer ON nation = c_nationkey UNION ALL SELECT s_suppkey, s_suppkey FROM supplier)""",
)
def target_expansion(spark, d):
    """A match stands for every member of its groups, and for itself."""
    supplier = table(spark, d, "supplier")
    targets = supplier.select("s_suppkey", F.explode(F.array("s_nationkey", (F.col("s_nationkey") + 1) % 25)).alias("c_nationkey"))
    return joins.expanded(targets, table(spark, d, "customer"), "s_suppkey", "c_custkey", "c_nationkey")


@query(
    "target_classes",
    """WITH t AS (SELECT s_suppkey, unnest([s_nationkey, (s_nationkey + 1) % 25]) AS nation FROM supplier), m AS (SELECT c_nationkey AS nation, count(*) AS members FROM customer GROUP BY 1)
    SELECT s_suppkey, CAST(sum(coalesce(members, 0)) AS BIGINT) + 1 AS reached, string_agg(nation, ',' ORDER BY nation) AS classes FROM (SELECT DISTINCT * FROM t) LEFT JOIN m USING (nation) GROUP BY 1""",
)
def target_classes(spark, d):
    """The classes that a match reaches, and how many members they have, with one for itself; members are those of ``target_members``."""
    targets = table(spark, d, "supplier").select("s_suppkey", F.explode(F.array("s_nationkey", (F.col("s_nationkey") + 1) % 25)).alias("c_nationkey")).distinct()
    members = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("members"))
    classes = F.array_join(F.transform(F.array_sort(F.collect_set("c_nationkey")), lambda n: n.cast("string")), ",")
    return targets.join(members, "c_nationkey", "left").groupBy("s_suppkey").agg((F.coalesce(F.sum("members"), F.lit(0)) + 1).alias("reached"), classes.alias("classes"))


@query("target_members", "SELECT c_nationkey AS class, c_custkey FROM customer")
def target_members(spark, d):
    """The members of each class, one row each, so that no pair of a match and a member is made."""
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("class"), "c_custkey")


@query("alias_keys", r"SELECT c_custkey, trim(regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) AS key FROM customer")
def alias_keys(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.comparison_key(F.col("c_name")).alias("key"))


@query(
    "land_shares",
    """WITH p AS (SELECT p_brand AS zip, p_type AS district, sum(p_size) AS land FROM part GROUP BY 1, 2), w AS (SELECT zip, sum(land) AS whole FROM p GROUP BY 1)
    SELECT zip, list(district ORDER BY district) AS districts, list(round(land / whole, 6) ORDER BY district) AS shares FROM p JOIN w USING (zip) GROUP BY 1""",
)
def land_shares(spark, d):
    """Each district's share of a code's land, in order; a share above 1 stops the query."""
    parts = table(spark, d, "part").groupBy(F.col("p_brand").alias("zip"), F.col("p_type").alias("district")).agg(F.sum("p_size").alias("land"))
    whole = parts.groupBy("zip").agg(F.sum("land").alias("whole"))
    share = F.col("land") / F.col("whole")
    checked = F.when(share > 1, F.raise_error(F.lit("a share above 1")).cast("double")).otherwise(F.round(share, 6))
    listed = parts.join(whole, "zip").groupBy("zip").agg(F.array_sort(F.collect_list(F.struct("district", checked.alias("share")))).alias("p"))
    return listed.select("zip", F.col("p.district").alias("districts"), F.col("p.share").alias("shares"))


@query("bounded_fit")
def bounded_fit(spark, d):
    """Late shipments by three signals, coefficients between 0 and 2: no SQL, being iterative."""
    lines = table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), F.lit(1.0).alias("one"), (F.col("l_discount") > 0.05).cast("double").alias("discount"), (F.col("l_quantity") > 25).cast("double").alias("quantity"))
    beta = fits.bounded_logistic(lines, ["one", "discount", "quantity"], "y", 1.0, [-5.0, 0.0, 0.0], [5.0, 2.0, 2.0])
    return spark.createDataFrame([(t, round(float(b), 6)) for t, b in zip(("one", "discount", "quantity"), beta)], "term string, coefficient double")


@query(
    "bootstrap_upper",
    """WITH s AS (SELECT o_custkey, sum(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY 1), u AS (SELECT s, n, draw, ('0x' || md5('7:' || draw || ':' || o_custkey)[1:8])::BIGINT / 4294967296.0::DOUBLE AS u FROM s, (SELECT unnest(range(0, 200)) AS draw)),
    t AS (SELECT draw, s, n, len(list_filter(list_transform(range(0, 8), lambda k: list_sum(list_transform(range(0, k + 1), lambda j: exp(-1) / gamma(j + 1)))), lambda c: u >= c)) AS t FROM u), m AS (SELECT draw, round(sum(t * s) / sum(t * n), 6) AS mean FROM t GROUP BY 1)
    SELECT quantile_disc(mean, 0.95) AS upper FROM m""",
)
def bootstrap_upper(spark, d):
    """The 95th of 200 draws of whole customers."""
    return fits.bootstrap_upper(table(spark, d, "orders"), "o_custkey", "o_totalprice", 200, 0.95, 7)


_YEARS = f"""SELECT year, ring, seq, x + 0.2 * (year - 2020) AS x, y FROM ({_CORNERS}), (SELECT unnest([2020, 2021, 2022]) AS year)"""


@query(
    "place_near_outline",
    f"""WITH p AS ({_POINTS}), v AS ({_YEARS}), s AS (SELECT a.year, a.ring, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS "by" FROM v a JOIN v b ON a.year = b.year AND a.ring = b.ring AND b.seq = (a.seq + 1) % 7),
    t AS (SELECT p.*, s.*, greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * ("by" - ay)) / (pow(bx - ax, 2) + pow("by" - ay, 2)))) AS t FROM p, s),
    m AS (SELECT c_custkey, year, ring, min(round(sqrt(pow(x - ax - t * (bx - ax), 2) + pow(y - ay - t * ("by" - ay), 2)), 9)) AS far,
        count(*) FILTER ((ay > y) <> ("by" > y) AND x < (bx - ax) * (y - ay) / nullif("by" - ay, 0) + ax) % 2 = 1 AS held FROM t GROUP BY 1, 2, 3),
    d AS (SELECT c_custkey, year, ring, CASE WHEN held THEN 0 ELSE far END AS distance FROM m WHERE held OR far <= 0.5)
    SELECT c_custkey, year, arg_min(ring, (distance, ring)) AS ring, min(distance) AS distance FROM d GROUP BY 1, 2""",
)
def place_near_outline(spark, d):
    """The ring that holds a place in each of three years, else the nearest within half a degree of its outline."""
    years = F.explode(F.array(*[F.lit(y) for y in (2020, 2021, 2022)])).alias("year")
    rings = _corners(spark, d).select("*", years).withColumn("x", F.col("x") + 0.2 * (F.col("year") - 2020))
    points = _points(spark, d).select("*", years)
    return spatial.near_outlines(points, rings, "ring", 0.5, 2.0, ["year"], "c_custkey")


@query(
    "nearest_light",
    f"""WITH p AS ({_POINTS}), l AS (SELECT p.* FROM p JOIN customer USING (c_custkey) WHERE c_acctbal < 0)
    SELECT p.c_custkey, round(min(sqrt(pow(p.x - l.x, 2) + pow(p.y - l.y, 2))), 9) AS distance FROM p JOIN l ON p.c_custkey <> l.c_custkey AND sqrt(pow(p.x - l.x, 2) + pow(p.y - l.y, 2)) <= 1.5 GROUP BY 1""",
)
def nearest_light(spark, d):
    """How far the nearest other place in the red is, within a degree and a half: only cells around a place that are as small as its neighbours are close are met."""
    places = _points(spark, d)
    lit = places.join(table(spark, d, "customer").where("c_acctbal < 0").select("c_custkey"), "c_custkey", "left_semi").select(F.col("c_custkey").alias("other"), "x", "y")
    return joins.nearest_within(places, lit, 1.5, 1, "c_custkey", "other").select("c_custkey", F.round("distance", 9).alias("distance"))


@query(
    "place_guard",
    f"""WITH r AS (SELECT c_custkey AS record, c_nationkey AS state, c_mktsegment AS town, x, y FROM ({_POINTS}) JOIN customer USING (c_custkey)), m AS (SELECT o_orderkey, state AS "at", x, y FROM orders JOIN r ON record = o_custkey),
    s AS (SELECT DISTINCT l_orderkey AS o_orderkey, CASE WHEN s_acctbal < 0 THEN NULL ELSE s_nationkey END AS state, r.town FROM lineitem JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN r ON r.record = s_suppkey AND r.state = s_nationkey),
    p AS (SELECT s.*, m."at", m.x, m.y, coalesce(s.state = m."at", s.state IS NULL) AS there, row_number() OVER () AS id FROM s JOIN m USING (o_orderkey) WHERE s.state IS NOT NULL OR s.town IS NOT NULL),
    n AS (SELECT p.id, count(*) > 0 AS known, bool_or(sqrt(pow(p.x - r.x, 2) + pow(p.y - r.y, 2)) <= 2.0) AS near FROM p JOIN r ON p.there AND r.state = p."at" AND r.town = p.town GROUP BY 1),
    v AS (SELECT o_orderkey, CASE WHEN NOT there THEN 'conflict' WHEN near THEN 'agrees' WHEN known THEN 'conflict' WHEN state IS NOT NULL THEN 'agrees' ELSE 'unknown' END AS v FROM p LEFT JOIN n USING (id))
    SELECT o_orderkey, coalesce(min(v), 'unknown') AS verdict FROM m LEFT JOIN v USING (o_orderkey) GROUP BY 1""",
)
def place_guard(spark, d):
    """Whether the places of an order's suppliers agree with its customer's; towns are the segments of a nation's customers, suppliers in the red state no nation."""
    customers = table(spark, d, "customer").join(_points(spark, d), "c_custkey")
    records = customers.select(F.col("c_custkey").alias("record"), F.col("c_nationkey").alias("state"), "x", "y")
    towns = customers.select(F.col("c_nationkey").alias("state"), F.col("c_mktsegment").alias("town"), "x", "y")
    home = customers.select(F.col("c_custkey").alias("s_suppkey"), F.col("c_nationkey").alias("s_nationkey"), F.col("c_mktsegment").alias("town"))
    suppliers = table(spark, d, "supplier").join(home, ["s_suppkey", "s_nationkey"], "left").select(F.col("s_suppkey").alias("l_suppkey"), F.when(~F.coalesce(F.col("s_acctbal") < 0, F.lit(False)), F.col("s_nationkey")).alias("state"), "town")
    stated = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey").join(suppliers, "l_suppkey").select("o_orderkey", "state", "town")
    matches = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("record"))
    return guard.place_verdicts(matches, stated, records, towns, 2.0, "o_orderkey")
