"""All queries of the library over the given tables, and the SQL of those that SQL can express.

Matrices: UE users x (event type, hour), PS parts x suppliers, CB customers x brands. Factors where a query needs some: three
patterns drawn by hash from the matrix's own rows and columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import d_sigmoid, gap, prox, sigmoid, uniform
from ..operators import aggregates, algebra, collective, metrics, splits
from ..operators.matrix import BoolMatrix, factorized
from ..sources import generators, readers
from . import continuous as co
from . import greedy
from . import threshold_search as ts

QUERIES: dict = {}
ORACLE_SQL: dict = {}
K = 3


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def read(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- matrices and their SQL --------------------------------------------------------------------------------------------


def ue(spark, d) -> BoolMatrix:
    e = read(spark, d, "events").select("user_id", F.concat_ws("_", "event_type", F.lpad(F.hour("ts").cast("string"), 2, "0")).alias("slot"))
    return BoolMatrix.of(e, "user_id", "slot")


def ps(spark, d) -> BoolMatrix:
    return BoolMatrix.of(read(spark, d, "lineitem"), "l_partkey", "l_suppkey")


def brand_sums(spark, d) -> DataFrame:
    o, li, p = (read(spark, d, t) for t in ("orders", "lineitem", "part"))
    joined = o.select("o_orderkey", "o_custkey").join(li.select("l_orderkey", "l_partkey", "l_quantity"), F.col("o_orderkey") == F.col("l_orderkey")).join(p.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy(F.col("o_custkey").alias("i"), F.col("p_brand").alias("j")).agg(F.sum("l_quantity").alias("q"))


UE = "ue AS (SELECT DISTINCT user_id AS i, event_type || '_' || lpad(CAST(hour(ts) AS VARCHAR), 2, '0') AS j FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND ts IS NOT NULL)"
PS = "ps AS (SELECT DISTINCT l_partkey AS i, l_suppkey AS j FROM lineitem)"
SUMS = "sums AS (SELECT o_custkey AS i, p_brand AS j, sum(l_quantity) AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)"
FS = "fs AS (SELECT CAST(unnest(range(3)) AS INTEGER) AS f)"


def uni(seed, *key) -> str:
    return f"(CAST(CAST('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(key)})), 1, 8) AS UBIGINT) AS DOUBLE) / CAST(4294967296 AS DOUBLE))"


UV = f"{UE}, {FS}, u AS (SELECT i, f FROM (SELECT DISTINCT i FROM ue), fs WHERE {uni('u', 'i', 'f')} < CAST(0.3 AS DOUBLE)), v AS (SELECT j, f FROM (SELECT DISTINCT j FROM ue), fs WHERE {uni('v', 'j', 'f')} < CAST(0.4 AS DOUBLE)), pd AS (SELECT DISTINCT i, j FROM u JOIN v USING (f))"
MASKS = UV + ", mu AS (SELECT i, CAST(sum(1 << f) AS BIGINT) AS mi FROM u GROUP BY i), mv AS (SELECT j, CAST(sum(1 << f) AS BIGINT) AS mj FROM v GROUP BY j)"


def patterns(x: BoolMatrix) -> greedy.Fit:
    """Three patterns by hash."""
    f = x.cells.sparkSession.range(K).select(F.col("id").cast("int").alias("f"))
    u = x.rows.crossJoin(f).filter(uniform("u", F.col("i"), F.col("f")) < 0.3)
    v = x.cols.crossJoin(f).filter(uniform("v", F.col("j"), F.col("f")) < 0.4)
    return greedy.Fit(u, v, K)


def factors(x: BoolMatrix) -> tuple[DataFrame, DataFrame]:
    """Real factors by hash, uniform in [0, 1)."""
    return co.init(x.rows, "i", K, 0.5, "uniform", 7), co.init(x.cols, "j", K, 0.5, "uniform", 7)


RUV = f"{UE}, {FS}, uu AS (SELECT i, f, {uni('7:i', 'i', 'f')} AS a FROM (SELECT DISTINCT i FROM ue), fs), vv AS (SELECT j, f, {uni('7:j', 'j', 'f')} AS b FROM (SELECT DISTINCT j FROM ue), fs)"
E6 = "CAST(1e-12 AS DOUBLE)"


def six(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), 6) for n in names})


# ---- loading -----------------------------------------------------------------------------------------------------------


@query(f"WITH {UE} SELECT i, j FROM ue")
def mx_load_ue(spark, d):
    return ue(spark, d).ones


@query(f"WITH {PS} SELECT i, j FROM ps")
def mx_load_ps(spark, d):
    return ps(spark, d).ones


@query(f"WITH {SUMS} SELECT i, j, CAST(q > 50 AS INTEGER) AS x FROM sums")
def mx_load_cbq(spark, d):
    return brand_sums(spark, d).select("i", "j", (F.col("q") > 50).cast("int").alias("x"))


@query("WITH r AS (SELECT l_partkey AS uid, l_suppkey AS iid, max(l_quantity) AS rating FROM lineitem GROUP BY ALL) SELECT uid AS i, iid AS j FROM r WHERE rating > 40 AND iid IN (SELECT s_suppkey FROM supplier)")
def mx_load_ratings(spark, d):
    r = read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("uid"), F.col("l_suppkey").alias("iid")).agg(F.max("l_quantity").alias("rating"))
    return readers.ratings_matrix(r, read(spark, d, "supplier").select(F.col("s_suppkey").alias("iid")), 40.0).ones


@query("SELECT p_type AS id, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS BIGINT) AS ord FROM (SELECT DISTINCT p_type FROM part)")
def mx_factorize_ids(spark, d):
    return factorized(read(spark, d, "part"), "p_type").withColumnRenamed("p_type", "id")


@query(f"WITH {UE}, r AS (SELECT i, dense_rank() OVER (ORDER BY i) - 1 AS oi FROM (SELECT DISTINCT i FROM ue)), c AS (SELECT j, dense_rank() OVER (ORDER BY j) - 1 AS oj FROM (SELECT DISTINCT j FROM ue)) SELECT CAST(oi AS BIGINT) AS i, CAST(oj AS BIGINT) AS j FROM ue JOIN r USING (i) JOIN c USING (j)")
def mx_positions(spark, d):
    return readers.with_positions(ue(spark, d))[0].ones


@query("SELECT DISTINCT c_custkey AS i, unnest(['segment_' || c_mktsegment, 'nation_' || CAST(c_nationkey AS VARCHAR), 'band_' || CAST(CAST(floor(c_acctbal / 1000) AS BIGINT) AS VARCHAR)]) AS j FROM customer")
def mx_attr_onehot(spark, d):
    parts = {"segment": F.col("c_mktsegment"), "nation": F.col("c_nationkey"), "band": F.floor(F.col("c_acctbal") / 1000)}
    return readers.one_hot(read(spark, d, "customer"), "c_custkey", parts).ones


@query("SELECT DISTINCT unnest(string_split(p_name, ' ')) AS i, p_partkey AS j FROM part")
def mx_attr_explode(spark, d):
    return readers.attribute_matrix(read(spark, d, "part"), "p_partkey", F.split("p_name", " ")).ones


@query("SELECT DISTINCT json_extract_string(props, '$.k') AS i, user_id AS j FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def mx_attr_json(spark, d):
    e = read(spark, d, "events").withColumn("v", F.map_values(F.from_json("props", "map<string,string>")))
    return readers.attribute_matrix(e, "user_id", F.col("v")).ones


@query(f"WITH {UE}, k AS (SELECT i FROM (SELECT DISTINCT i FROM ue) ORDER BY md5(concat_ws(':', '5:i', i)), i LIMIT 50) SELECT i, j FROM ue WHERE i IN (SELECT i FROM k)")
def mx_sample_rows(spark, d):
    return aggregates.sample(ue(spark, d), n_rows=50, seed=5).ones


FOUR = "rt AS (SELECT o_custkey AS i, l_partkey AS j, max(l_quantity) AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL), us AS (SELECT DISTINCT CAST(i AS VARCHAR) AS id FROM rt), it AS (SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS id FROM part), raw AS (SELECT 0 AS mat, 0 AS fa, 1 AS fb, CAST(i AS VARCHAR) AS a, CAST(j AS VARCHAR) AS b FROM rt WHERE q > 40 UNION ALL SELECT DISTINCT 1, 0, 2, CAST(c_custkey AS VARCHAR), unnest(['segment_' || c_mktsegment, 'nation_' || CAST(c_nationkey AS VARCHAR)]) FROM customer UNION ALL SELECT DISTINCT 2, 3, 1, unnest(string_split(p_name, ' ')), CAST(p_partkey AS VARCHAR) FROM part UNION ALL SELECT DISTINCT 3, 4, 1, p_type, CAST(p_partkey AS VARCHAR) FROM part), ids AS (SELECT 0 AS fid, id FROM us UNION ALL SELECT 1, id FROM it UNION SELECT 2, b FROM raw WHERE mat = 1 UNION SELECT 3, a FROM raw WHERE mat = 2 UNION SELECT 4, a FROM raw WHERE mat = 3), dims AS (SELECT fid, id, row_number() OVER (PARTITION BY fid ORDER BY id) - 1 AS ord FROM ids)"


@query(f"WITH {FOUR} SELECT mat, x.ord AS i, y.ord AS j, 1 AS x FROM raw JOIN dims x ON x.fid = fa AND x.id = a JOIN dims y ON y.fid = fb AND y.id = b")
def mx_load_four(spark, d):
    o, li, p, c = (read(spark, d, t) for t in ("orders", "lineitem", "part", "customer"))
    r = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("uid"), F.col("l_partkey").alias("iid")).agg(F.max("l_quantity").alias("rating"))
    ratings = readers.ratings_matrix(r, p.select(F.col("p_partkey").alias("iid")), 40.0)
    profiles = readers.one_hot(c, "c_custkey", {"segment": F.col("c_mktsegment"), "nation": F.col("c_nationkey")})
    names, kinds = (readers.attribute_matrix(p, "p_partkey", v, ratings.cols) for v in (F.split("p_name", " "), F.array("p_type")))
    return readers.combined(ratings, profiles, names, kinds)[0]


SUMMED = f"WITH {PS}, s AS (SELECT 'row' AS axis, CAST(i AS VARCHAR) AS id, count(*) AS n FROM ps GROUP BY i UNION ALL SELECT 'col', CAST(j AS VARCHAR), count(*) FROM ps GROUP BY j)"


@query(f"{SUMMED} SELECT * FROM s")
def mx_row_col_sums(spark, d):
    return aggregates.axis_sums(ps(spark, d))


@query(f"{SUMMED} SELECT axis, count(*) AS num, min(n) AS least, median(n) AS median, round(avg(n), 6) AS mean, max(n) AS most FROM s GROUP BY axis")
def mx_summary(spark, d):
    return six(aggregates.summary(ps(spark, d)), "mean")


# ---- algebra -----------------------------------------------------------------------------------------------------------


@query(f"WITH {UV} SELECT i, j FROM pd")
def bool_matmul(spark, d):
    fit = patterns(ue(spark, d))
    return fit.predict()


@query(f"WITH {MASKS} SELECT i, j, coalesce((mi & mj) <> 0, false) AS hit FROM ue LEFT JOIN mu USING (i) LEFT JOIN mv USING (j)")
def bool_matmul_masks(spark, d):
    x = ue(spark, d)
    fit = patterns(x)
    return algebra.predicted(x.ones, fit.u, fit.v)


@query(f"WITH {RUV} SELECT i, j, round(sum(a * b), 6) AS x FROM uu JOIN vv USING (f) GROUP BY i, j")
def real_matmul(spark, d):
    u, v = factors(ue(spark, d))
    return six(algebra.matmul(co.long(u, "i", K), co.long(v, "j", K)), "x")


@query(f"WITH {UV} SELECT i, j FROM ue UNION SELECT i, j FROM pd")
def bool_or(spark, d):
    x = ue(spark, d)
    return algebra.either(x.ones, patterns(x).predict())


@query(f"WITH {UV} SELECT i, j FROM ue INTERSECT SELECT i, j FROM pd")
def bool_and(spark, d):
    x = ue(spark, d)
    return algebra.both(x.ones, patterns(x).predict())


@query(f"WITH {UE} SELECT a.i, b.j FROM (SELECT DISTINCT i FROM ue) a, (SELECT DISTINCT j FROM ue) b EXCEPT SELECT i, j FROM ue")
def bool_not(spark, d):
    x = ue(spark, d)
    return algebra.invert(x.ones, x.rows, x.cols)


@query(f"WITH {UV} SELECT i, j, CAST(coalesce(a.x, 0) - coalesce(b.x, 0) AS BIGINT) AS x FROM (SELECT *, 1 AS x FROM ue) a FULL JOIN (SELECT *, 1 AS x FROM pd) b USING (i, j)")
def subtract(spark, d):
    x = ue(spark, d)
    return algebra.subtract(x.cells, patterns(x).predict().withColumn("x", F.lit(1)))


@query(f"WITH {UV} SELECT CAST(count(*) AS BIGINT) AS x, count(*) > 0 AS nonzero FROM (SELECT DISTINCT i FROM u WHERE f = 0) JOIN (SELECT DISTINCT i FROM u WHERE f = 1) USING (i)")
def dot(spark, d):
    u = patterns(ue(spark, d)).u.withColumn("x", F.lit(1))
    return algebra.dot(u.filter("f = 0"), u.filter("f = 1"))


@query(f"WITH {SUMS} SELECT i, j, round(pow(q, CAST(0.5 AS DOUBLE)) * CAST(0.1 AS DOUBLE), 6) AS x FROM sums")
def power_scaled(spark, d):
    return six(algebra.scaled(algebra.power(brand_sums(spark, d).withColumnRenamed("q", "x"), 0.5), 0.1), "x")


@query(f"WITH {RUV} SELECT DISTINCT i, j FROM uu JOIN vv USING (f) WHERE a > CAST(0.7 AS DOUBLE) AND b > CAST(0.6 AS DOUBLE)")
def threshold_predict(spark, d):
    u, v = factors(ue(spark, d))
    return algebra.threshold_prediction(co.long(u, "i", K), co.long(v, "j", K), 0.7, 0.6)


@query(f"WITH {RUV} SELECT DISTINCT i, j FROM uu JOIN vv USING (f) WHERE a > CAST([0.5, 0.7, 0.9] AS DOUBLE[])[f + 1] AND b > CAST([0.4, 0.6, 0.8] AS DOUBLE[])[f + 1]")
def threshold_predict_columns(spark, d):
    u, v = factors(ue(spark, d))
    table = lambda ts: spark.createDataFrame(list(enumerate(ts)), "f int, t double")
    return algebra.threshold_prediction(co.long(u, "i", K), co.long(v, "j", K), table([0.5, 0.7, 0.9]), table([0.4, 0.6, 0.8]))


@query(f"WITH {UV} SELECT i, j FROM ue EXCEPT SELECT i, j FROM pd")
def residual(spark, d):
    x = ue(spark, d)
    return algebra.residual(x.ones, patterns(x).predict())


def emb(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("f", "y")).select("vec_id", "f", F.col("y").cast("double").alias("x"))


EMB = "emb AS (SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS f, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"


@query(f"WITH {EMB} SELECT vec_id, f, round(CAST(2 AS DOUBLE) * (x - (SELECT min(x) FROM emb)) / ((SELECT max(x) FROM emb) - (SELECT min(x) FROM emb)) - 1, 6) AS x FROM emb")
def to_interval(spark, d):
    return six(algebra.to_interval(emb(spark, d), -1.0, 1.0), "x")


@query(f"WITH {SUMS}, r AS (SELECT q, CAST(dense_rank() OVER (ORDER BY q) - 1 AS DOUBLE) AS r FROM (SELECT DISTINCT q FROM sums)) SELECT i, j, round(r / (SELECT count(*) FROM r), 6) AS x FROM sums JOIN r USING (q)")
def unique_mapping(spark, d):
    return six(algebra.unique_mapping(brand_sums(spark, d).withColumnRenamed("q", "x")), "x")


@query(f"WITH {SUMS}, r AS (SELECT j, q, CAST(row_number() OVER (PARTITION BY j ORDER BY q) - 1 AS DOUBLE) / count(*) OVER (PARTITION BY j) AS r FROM (SELECT DISTINCT j, q FROM sums)) SELECT i, j, round(r, 6) AS x FROM sums JOIN r USING (j, q)")
def unique_mapping_columns(spark, d):
    return six(algebra.unique_mapping(brand_sums(spark, d).withColumnRenamed("q", "x"), "j"), "x")


@query(f"WITH {RUV}, tu AS (SELECT f, max(a) AS m FROM uu GROUP BY f), tv AS (SELECT f, max(b) AS n FROM vv GROUP BY f) SELECT i, f, round(a * sqrt(n / m), 6) AS x FROM uu JOIN tu USING (f) JOIN tv USING (f)")
def normalize_balance(spark, d):
    u, v = factors(ue(spark, d))
    return six(co.long(co.normalized(u, v, K)[0], "i", K), "x")


@query(f"WITH {RUV}, tu AS (SELECT f, max(a) AS m FROM uu GROUP BY f) SELECT i, f, round(a / m, 6) AS x FROM uu JOIN tu USING (f)")
def normalize_columnwise(spark, d):
    u, v = factors(ue(spark, d))
    return six(co.long(co.normalized(u, v, K, "columnwise")[0], "i", K), "x")


@query(f"WITH {RUV}, r AS (SELECT b, CAST(row_number() OVER (ORDER BY b) - 1 AS DOUBLE) / count(*) OVER () AS x FROM (SELECT DISTINCT b FROM vv)) SELECT j, f, round(x, 6) AS x FROM vv JOIN r USING (b)")
def normalize_matrixwise_mapping(spark, d):
    u, v = factors(ue(spark, d))
    return six(co.long(co.normalized(u, v, K, "matrixwise-mapping")[1], "j", K), "x")


@query(f"WITH {RUV}, r AS (SELECT f, a, CAST(row_number() OVER (PARTITION BY f ORDER BY a) - 1 AS DOUBLE) / count(*) OVER (PARTITION BY f) AS x FROM (SELECT DISTINCT f, a FROM uu)) SELECT i, f, round(x, 6) AS x FROM uu JOIN r USING (f, a)")
def normalize_columnwise_mapping(spark, d):
    u, v = factors(ue(spark, d))
    return six(co.long(co.normalized(u, v, K, "columnwise-mapping")[0], "i", K), "x")


@query(f"WITH {RUV}, tv AS (SELECT max(b) AS m FROM vv) SELECT j, f, round(b / m, 6) AS x FROM vv, tv")
def normalize_matrixwise(spark, d):
    u, v = factors(ue(spark, d))
    return six(co.long(co.normalized(u, v, K, "matrixwise")[1], "j", K), "x")


@query(f"WITH {EMB} SELECT vec_id, f, round(1 / (1 + exp(-x)), 6) AS s, round(1 / (1 + exp(-x)) * (1 - 1 / (1 + exp(-x))), 6) AS ds FROM emb")
def sigmoid_values(spark, d):
    return emb(spark, d).select("vec_id", "f", F.round(sigmoid(F.col("x")), 6).alias("s"), F.round(d_sigmoid(F.col("x")), 6).alias("ds"))


# ---- generators, sized by the tables -----------------------------------------------------------------------------------


def dims(spark, d) -> tuple[int, int]:
    return read(spark, d, "customer").count(), read(spark, d, "supplier").count()


DIMS = "d AS (SELECT (SELECT count(*) FROM customer) AS m, (SELECT count(*) FROM supplier) AS n)"
SYN = f"{DIMS}, {FS}, su AS (SELECT i, f FROM (SELECT unnest(range(m)) AS i, CAST(ceil(m / 100.0) AS BIGINT) AS h FROM d), fs WHERE (i >= f * h AND i < (f + 1) * h) OR (i >= 3 * h AND {uni('3:i', 'i', 'f')} < CAST(0.2 AS DOUBLE))), sv AS (SELECT j, f FROM (SELECT unnest(range(n)) AS j, CAST(ceil(n / 100.0) AS BIGINT) AS h FROM d), fs WHERE (j >= f * h AND j < (f + 1) * h) OR (j >= 3 * h AND {uni('3:j', 'j', 'f')} < CAST(0.3 AS DOUBLE))), sx AS (SELECT DISTINCT i, j FROM su JOIN sv USING (f))"


def synthetic(spark, d) -> tuple:
    """Both sides, and the numbers of rows and columns."""
    m, n = dims(spark, d)
    return *generators.synthetic(spark, m, n, K, (0.2, 0.3), 3), m, n


@query(f"WITH {DIMS}, {FS}, b AS (SELECT f, CAST(floor(f * (m - m / 2.5) / 2) AS BIGINT) AS s, CAST(floor(m / 2.5 + f * (m - m / 2.5) / 2 + 1e-9) AS BIGINT) AS e, CAST(floor(f * (n - n / 2.0) / 2) AS BIGINT) AS s2, CAST(floor(n / 2.0 + f * (n - n / 2.0) / 2 + 1e-9) AS BIGINT) AS e2 FROM d, fs), bu AS (SELECT f, unnest(range(s, e)) AS i FROM b), bv AS (SELECT f, unnest(range(s2, e2)) AS j FROM b) SELECT DISTINCT i, j FROM bu JOIN bv USING (f)")
def gen_block_diagonal(spark, d):
    m, n = dims(spark, d)
    return generators.matrix(*generators.block_diagonal(spark, m, n, K, (0.25, 0.5)), m, n).ones


def blocks_sql() -> str:
    """Draws one after the other, kept if they fit and neither hold nor lie within a kept one, until there are three."""
    draw = lambda d, what: uni(11, "t", str(d), f"'{what}'")
    parts = []
    for d, size in enumerate("mn"):
        least, most = f"floor(CAST({size} AS DOUBLE) / 3 * 0.5)", f"ceil(CAST({size} AS DOUBLE) / 3 * 2)"
        parts.append(f"CAST(floor({draw(d, 'start')} * {size}) AS BIGINT) AS s{d}, CAST(greatest(1, {least} + floor({draw(d, 'size')} * ({most} - {least}))) AS BIGINT) AS l{d}")
    inside = lambda a, b: " AND ".join(f"{b}.s{d} <= {a}.s{d} AND {a}.e{d} <= {b}.e{d}" for d in (0, 1))
    one = "{'s0': dr.s0, 'e0': dr.e0, 's1': dr.s1, 'e1': dr.e1}"
    return f"""WITH RECURSIVE {DIMS}, dw AS (SELECT t, m, n, {", ".join(parts)} FROM d, (SELECT unnest(range(10000)) AS t)),
    dr AS (SELECT t, m, n, s0, s0 + l0 AS e0, s1, s1 + l1 AS e1 FROM dw),
    rec(t, found) AS (
      SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(s0 BIGINT, e0 BIGINT, s1 BIGINT, e1 BIGINT)[])
      UNION ALL
      SELECT rec.t + 1, CASE WHEN dr.e0 <= m AND dr.e1 <= n AND len([1 FOR x IN found IF ({inside("x", "dr")}) OR ({inside("dr", "x")})]) = 0 THEN list_append(found, {one}) ELSE found END
      FROM rec JOIN dr ON dr.t = rec.t WHERE len(found) < 3),
    bl AS (SELECT unnest(found, recursive := true) FROM rec WHERE len(found) = 3), li AS (SELECT s1, e1, unnest(range(s0, e0)) AS i FROM bl)
    SELECT DISTINCT i, unnest(range(s1, e1)) AS j FROM li"""


@query(blocks_sql())
def gen_blocks(spark, d):
    m, n = dims(spark, d)
    return generators.matrix(*generators.blocks(spark, m, n, K, True, seed=11), m, n).ones


@query(f"WITH {SYN} SELECT i, j FROM sx")
def gen_synthetic(spark, d):
    return generators.matrix(*synthetic(spark, d)).ones


@query(f"WITH {SYN} SELECT i, j FROM sx WHERE {uni('9:pos', 'i', 'j')} >= CAST(0.4 AS DOUBLE) UNION SELECT i, j FROM (SELECT unnest(range(m)) AS i FROM d), (SELECT unnest(range(n)) AS j FROM d) WHERE {uni('9:neg', 'i', 'j')} < CAST(0.01 AS DOUBLE)")
def gen_noise(spark, d):
    return generators.noisy_product(*synthetic(spark, d), 0.4, 0.01, 9).ones


@query(f"WITH {SYN}, r AS (SELECT i, row_number() OVER (ORDER BY md5(concat_ws(':', '4:i', i)), i) - 1 AS a FROM (SELECT unnest(range(m)) AS i FROM d)), c AS (SELECT j, row_number() OVER (ORDER BY md5(concat_ws(':', '4:j', j)), j) - 1 AS b FROM (SELECT unnest(range(n)) AS j FROM d)) SELECT a AS i, b AS j FROM sx JOIN r USING (i) JOIN c USING (j)")
def gen_shuffle(spark, d):
    return generators.shuffle_product(*synthetic(spark, d), 4).ones


@query(f"WITH {SYN}, p AS (SELECT f, CAST(row_number() OVER (ORDER BY md5(concat_ws(':', '6:u', f)), f) - 1 AS INTEGER) AS g FROM fs) SELECT i, g AS f FROM su JOIN p USING (f)")
def gen_shuffle_factors(spark, d):
    u, v, *_ = synthetic(spark, d)
    return generators.shuffle_factors(u, v, 6)[0].select("i", "f")


@query(f"WITH {SYN} SELECT round((SELECT count(*) FROM sx) / CAST(m * n AS DOUBLE), 6) AS density FROM d")
def gen_density(spark, d):
    return six(generators.product_density(*synthetic(spark, d)), "density")


@query(f"WITH {SYN} SELECT round((SELECT count(*) FROM (SELECT i, j FROM su JOIN sv USING (f) GROUP BY i, j HAVING count(*) > 1)) / CAST(m * n AS DOUBLE), 6) AS overlap FROM d")
def gen_overlap(spark, d):
    return six(generators.overlap(*synthetic(spark, d)), "overlap")


# ---- splits ------------------------------------------------------------------------------------------------------------

RANKED = f"{UE}, t AS (SELECT count(*) AS n FROM ue), r AS (SELECT i, j, row_number() OVER (ORDER BY md5(concat_ws(':', '1997', i, j)), i, j) - 1 AS rank FROM ue)"


@query(f"WITH {RANKED}, s AS (SELECT CAST(ceil(n * CAST(0.1 AS DOUBLE)) AS BIGINT) AS v, CAST(ceil(n * CAST(0.2 AS DOUBLE)) AS BIGINT) AS t, n FROM t) SELECT i, j, CASE WHEN rank < n - v - s.t THEN 'train' WHEN rank < n - s.t THEN 'val' ELSE 'test' END AS part FROM r, s")
def split_ratio(spark, d):
    return splits.ratio_split(ue(spark, d), None, 0.1, 0.2, 1997)


@query(f"WITH {RANKED}, s AS (SELECT n - CAST(ceil(n * CAST(0.2 AS DOUBLE)) AS BIGINT) AS n FROM t) SELECT i, j, CASE WHEN rank >= n THEN 'test' WHEN (CASE WHEN rank < n // 3 + CAST(n % 3 > 0 AS BIGINT) THEN 0 WHEN rank < 2 * (n // 3) + least(n % 3, 2) THEN 1 ELSE 2 END) = 1 THEN 'val' ELSE 'train' END AS part FROM r, s")
def split_cv_fold(spark, d):
    return splits.fold_parts(splits.cross_validation(ue(spark, d), 3, 0.2, 1997), 1).drop("fold")


def fine(seed, *key) -> str:
    return f"(CAST(CAST('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(key)})), 1, 13) AS UBIGINT) AS DOUBLE) / CAST(4503599627370496 AS DOUBLE))"


def negatives_sql(kind: str, share: int = 5) -> str:
    """CTE ng: t, i, j of the first ones / share zeros that draws find; four draws for each one of the matrix are enough."""
    if kind == "uniform":
        spans = lambda k: f"SELECT {k}, o AS s, o + 1 AS e FROM (SELECT {k}, row_number() OVER (ORDER BY {k}) - 1 AS o FROM (SELECT DISTINCT {k} FROM ue))"
    else:
        spans = lambda k: f"SELECT {k}, sum(w) OVER (ORDER BY {k}) - w AS s, sum(w) OVER (ORDER BY {k}) AS e FROM (SELECT {k}, count(*) AS w FROM ue GROUP BY {k})"
    at = lambda k: f"floor({fine(f'2023:{k}', 't')} * (SELECT max(e) FROM s{k}))"
    return f"{UE}, pn AS (SELECT count(*) AS p FROM ue), si AS ({spans('i')}), sj AS ({spans('j')}), dr AS (SELECT t, {at('i')} AS a, {at('j')} AS b FROM (SELECT unnest(range(4 * p)) AS t FROM pn)), ng AS (SELECT i, j, min(t) AS t FROM dr JOIN si ON a >= si.s AND a < si.e JOIN sj ON b >= sj.s AND b < sj.e WHERE (i, j) NOT IN (SELECT (i, j) FROM ue) GROUP BY i, j ORDER BY t LIMIT (SELECT p // {share} FROM pn))"


@query(f"WITH {negatives_sql('uniform')} SELECT i, j, 0 AS x FROM ng")
def neg_uniform(spark, d):
    x = ue(spark, d)
    return splits.negative_sample(x, x.ones.count() // 5, "uniform", 2023)


@query(f"WITH {negatives_sql('popularity')} SELECT i, j, 0 AS x FROM ng")
def neg_popularity(spark, d):
    x = ue(spark, d)
    return splits.negative_sample(x, x.ones.count() // 5, "popularity", 2023)


DEALT = "nr AS (SELECT i, j, row_number() OVER (ORDER BY md5(concat_ws(':', '2023:part', i, j)), i, j) - 1 AS rank FROM ng)"


@query(f"WITH {negatives_sql('popularity')}, {DEALT}, {RANKED.removeprefix(UE + ', ')}, q AS (SELECT p // 5 AS k, p // 10 AS h, p AS n, CAST(ceil(p * CAST(0.1 AS DOUBLE)) AS BIGINT) AS v, CAST(ceil(p * CAST(0.2 AS DOUBLE)) AS BIGINT) AS t FROM pn) SELECT i, j, 1 AS x, CASE WHEN rank < n - v - t THEN 'train' WHEN rank < n - t THEN 'val' ELSE 'test' END AS part FROM r, q UNION ALL SELECT i, j, 0, CASE WHEN rank < h THEN 'train' WHEN rank < h + (k - h) // 2 THEN 'val' ELSE 'test' END FROM nr, q")
def split_ratio_negatives(spark, d):
    x = ue(spark, d)
    p = x.ones.count()
    k, h = p // 5, p // 10
    known = splits.negative_parts(x, h, (k - h) // 2, k - h - (k - h) // 2, "popularity", 2023)
    return splits.appended(splits.ratio_split(x, None, 0.1, 0.2, 1997), known)


@query(f"WITH {negatives_sql('uniform')}, {DEALT}, q AS (SELECT p // 5 - p // 20 AS n FROM pn) SELECT i, j, 0 AS x, CAST(CASE WHEN rank >= n THEN -1 WHEN rank < n // 3 + CAST(n % 3 > 0 AS BIGINT) THEN 0 WHEN rank < 2 * (n // 3) + least(n % 3, 2) THEN 1 ELSE 2 END AS INTEGER) AS fold FROM nr, q")
def split_cv_negatives(spark, d):
    x = ue(spark, d)
    p = x.ones.count()
    return splits.negative_folds(x, 3, p // 5 - p // 20, p // 20, "uniform", 2023)


# ---- metrics -----------------------------------------------------------------------------------------------------------


def metric_sql(p="p", q="q", tp="tp", n="n") -> str:
    d = lambda a, b: f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0)"
    tpr, tnr, ppv = d(tp, p), d(f"({n} - {p} - {q} + {tp})", f"({n} - {p})"), d(tp, q)
    err = d(f"({q} + {p} - 2 * {tp})", n)
    parts = {
        "TP": f"CAST({tp} AS BIGINT)", "FP": f"CAST({q} - {tp} AS BIGINT)", "TN": f"CAST({n} - {p} - {q} + {tp} AS BIGINT)", "FN": f"CAST({p} - {tp} AS BIGINT)",
        "TPR": f"round({tpr}, 6)", "TNR": f"round({tnr}, 6)", "FPR": f"round(1 - {tnr}, 6)", "FNR": f"round(1 - {tpr}, 6)", "PPV": f"round({ppv}, 6)",
        "ACC": f"round(1 - {err}, 6)", "ERR": f"round({err}, 6)", "F1": f"round(coalesce(2 * {tpr} * {ppv} / nullif({tpr} + {ppv}, 0), 0), 6)", "RMSE": f"round(sqrt({err}), 6)", "MAE": f"round({err}, 6)",
    }
    return ", ".join(f"{v} AS {k}" for k, v in parts.items())


RATES = ("TPR", "TNR", "FPR", "FNR", "PPV", "ACC", "ERR", "F1", "RMSE", "MAE")
COUNTED = f"{UV}, s AS (SELECT i, j, CAST(max(a) AS BIGINT) AS a, CAST(max(b) AS BIGINT) AS b FROM (SELECT i, j, 1 AS a, 0 AS b FROM ue UNION ALL SELECT i, j, 0, 1 FROM pd) GROUP BY i, j), nr AS (SELECT count(DISTINCT i) AS m, count(DISTINCT j) AS n FROM ue)"


@query(f"WITH c AS (SELECT sum(quality) AS p, sum(toxic) AS q, sum(quality * toxic) AS tp, count(*) AS n FROM labels) SELECT {metric_sql()} FROM c")
def metrics_vector(spark, d):
    t = read(spark, d, "labels").agg(F.sum("quality").alias("p"), F.sum("toxic").alias("q"), F.sum(F.col("quality") * F.col("toxic")).alias("tp"), F.count(F.lit(1)).alias("n"))
    return six(metrics.metrics(t), *RATES)


@query(f"WITH {COUNTED}, c AS (SELECT sum(a) AS p, sum(b) AS q, sum(a * b) AS tp, (SELECT m * n FROM nr) AS n FROM s) SELECT {metric_sql()} FROM c")
def metrics_matrix(spark, d):
    x = ue(spark, d)
    fit = patterns(x)
    return six(metrics.metrics(metrics.factor_counts(x.ones, fit.u, fit.v, x.m * x.n)), *RATES)


@query(f"WITH {COUNTED}, c AS (SELECT i, sum(a) AS p, sum(b) AS q, sum(a * b) AS tp, (SELECT n FROM nr) AS n FROM s GROUP BY i) SELECT i, {metric_sql()} FROM c")
def metrics_by_row(spark, d):
    x = ue(spark, d)
    return six(metrics.metrics(metrics.counts(x.ones, patterns(x).predict(), x.n, "i", x.rows)), *RATES)


@query(f"WITH {COUNTED}, c AS (SELECT j, sum(a) AS p, sum(b) AS q, sum(a * b) AS tp, (SELECT m FROM nr) AS n FROM s GROUP BY j) SELECT j, {metric_sql()} FROM c")
def metrics_by_col(spark, d):
    x = ue(spark, d)
    return six(metrics.metrics(metrics.counts(x.ones, patterns(x).predict(), x.m, "j", x.cols)), *RATES)


@query(f"WITH {COUNTED} SELECT round(sqrt(sum((a - b) * (a - b)) / CAST((SELECT m * n FROM nr) AS DOUBLE)), 6) AS RMSE, round(sum(abs(a - b)) / CAST((SELECT m * n FROM nr) AS DOUBLE), 6) AS MAE FROM s")
def real_errors(spark, d):
    x = ue(spark, d)
    return six(metrics.real_errors(x.cells, patterns(x).predict().withColumn("x", F.lit(1)), x.m * x.n), "RMSE", "MAE")


@query(f"WITH {negatives_sql('uniform')}, {MASKS.removeprefix(UE + ', ')}, g AS (SELECT i, j, 1 AS x FROM ue UNION ALL SELECT i, j, 0 FROM ng), h AS (SELECT x, CAST(coalesce((mi & mj) <> 0, false) AS BIGINT) AS hit FROM g LEFT JOIN mu USING (i) LEFT JOIN mv USING (j)), c AS (SELECT sum(x) AS p, sum(hit) AS q, sum(hit * x) AS tp, count(*) AS n FROM h) SELECT {metric_sql()} FROM c")
def eval_prediction(spark, d):
    x = ue(spark, d)
    fit = patterns(x)
    known = splits.with_negatives(x, splits.negative_sample(x, x.ones.count() // 5, "uniform", 2023))
    return six(metrics.metrics(metrics.stored_counts(known.cells, fit.u, fit.v)), *RATES)


WHOLE = f"{COUNTED}, c AS (SELECT CAST(sum(a) AS BIGINT) AS p, CAST(sum(b) AS BIGINT) AS q, CAST(sum(a * b) AS BIGINT) AS tp FROM s)"


@query(f"WITH {WHOLE} SELECT CAST((SELECT count(*) FROM u) + (SELECT count(*) FROM v) + 2 * (q - tp) + 3 * (p - tp) AS DOUBLE) AS description_length FROM c")
def description_length(spark, d):
    x = ue(spark, d)
    fit = patterns(x)
    return metrics.description_length(metrics.factor_counts(x.ones, fit.u, fit.v, x.m * x.n), fit.u.count() + fit.v.count(), 1, 2, 3)


@query(f"WITH {COUNTED}, c AS (SELECT j, sum(a) AS p, sum(b) AS q, sum(a * b) AS tp FROM s GROUP BY j) SELECT j, CAST(2 * (q - tp) + 8 * (p - tp) AS DOUBLE) AS error, CAST(8 * tp - 2 * (q - tp) AS DOUBLE) AS cover FROM c")
def cover_by_col(spark, d):
    x = ue(spark, d)
    t = metrics.counts(x.ones, patterns(x).predict(), x.m, "j", x.cols)
    return t.select("j", metrics.weighted_error(2, 8).alias("error"), metrics.coverage_score(2, 8).alias("cover"))


# ---- collective --------------------------------------------------------------------------------------------------------

FACTORS = [[0, 1], [0, 2], [3, 1]]  # customer x brand, customer x segment, part type x brand


def related(spark, d) -> tuple[DataFrame, DataFrame]:
    """Cells (mat, i, j, x) by position, and dims (fid, ord, id)."""
    c, p, s = read(spark, d, "customer"), read(spark, d, "part"), brand_sums(spark, d)
    ids = [c.select(F.col("c_custkey").cast("string").alias("id")), p.select(F.col("p_brand").alias("id")), c.select(F.col("c_mktsegment").alias("id")), p.select(F.col("p_type").alias("id"))]
    dim = [factorized(t, "id") for t in ids]
    pairs = [s.select(F.col("i").cast("string").alias("a"), F.col("j").alias("b")), c.select(F.col("c_custkey").cast("string").alias("a"), F.col("c_mktsegment").alias("b")), p.select(F.col("p_type").alias("a"), F.col("p_brand").alias("b"))]
    cells, out = None, None
    for k, (a, b) in enumerate(FACTORS):
        one = pairs[k].distinct().join(dim[a].select(F.col("id").alias("a"), F.col("ord").alias("i")), "a").join(dim[b].select(F.col("id").alias("b"), F.col("ord").alias("j")), "b")
        one = one.select(F.lit(k).alias("mat"), "i", "j", F.lit(1).alias("x"))
        cells = one if cells is None else cells.unionByName(one)
    for f, t in enumerate(dim):
        one = t.select(F.lit(f).alias("fid"), "ord", "id")
        out = one if out is None else out.unionByName(one)
    return cells, out


DIM = "dim AS (SELECT 0 AS fid, id, row_number() OVER (ORDER BY id) - 1 AS ord FROM (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS id FROM customer) UNION ALL SELECT 1, id, row_number() OVER (ORDER BY id) - 1 FROM (SELECT DISTINCT p_brand AS id FROM part) UNION ALL SELECT 2, id, row_number() OVER (ORDER BY id) - 1 FROM (SELECT DISTINCT c_mktsegment AS id FROM customer) UNION ALL SELECT 3, id, row_number() OVER (ORDER BY id) - 1 FROM (SELECT DISTINCT p_type AS id FROM part))"
CELLS = f"{SUMS}, {DIM}, raw AS (SELECT DISTINCT 0 AS mat, 0 AS ra, 1 AS rb, CAST(i AS VARCHAR) AS a, j AS b FROM sums UNION ALL SELECT DISTINCT 1, 0, 2, CAST(c_custkey AS VARCHAR), c_mktsegment FROM customer UNION ALL SELECT DISTINCT 2, 3, 1, p_type, p_brand FROM part), cells AS (SELECT mat, ra, rb, x.ord AS i, y.ord AS j FROM raw JOIN dim x ON x.fid = ra AND x.id = a JOIN dim y ON y.fid = rb AND y.id = b), st AS (SELECT fid, size, side, CAST(coalesce(sum(size) OVER (PARTITION BY side ORDER BY fid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM (SELECT fid, count(*) AS size, CASE WHEN fid IN (0, 3) THEN 'row' ELSE 'col' END AS side FROM dim GROUP BY fid))"


@query(f"WITH {CELLS} SELECT fid, size, side, start FROM st")
def collective_starts(spark, d):
    return collective.starts(related(spark, d)[1], FACTORS)


@query(f"WITH {CELLS} SELECT i + x.start AS i, j + y.start AS j, 1 AS x FROM cells JOIN st x ON x.fid = ra JOIN st y ON y.fid = rb")
def collective_concat(spark, d):
    cells, dim = related(spark, d)
    return collective.concat(cells, dim, FACTORS)


@query(f"WITH {CELLS} SELECT mat, i, j, 1 AS x FROM cells")
def collective_split(spark, d):
    cells, dim = related(spark, d)
    return collective.split(collective.concat(cells, dim, FACTORS), dim, FACTORS)


@query(f"WITH {CELLS}, k AS (SELECT ord FROM dim WHERE fid = 1 ORDER BY md5(concat_ws(':', '8', id)), id LIMIT 7) SELECT mat, i, j, 1 AS x FROM cells WHERE mat = 1 OR j IN (SELECT ord FROM k)")
def collective_sample(spark, d):
    cells, dim = related(spark, d)
    return collective.sample_dimension(cells, dim, FACTORS, 1, 7, 8)[0]


@query(f"WITH {CELLS}, g AS (SELECT mat, i, j, f FROM cells, (SELECT CAST(unnest(range(3)) AS INTEGER) AS f) WHERE (i + j) % 3 = f UNION SELECT mat, i + 1, j, f FROM cells, (SELECT CAST(unnest(range(3)) AS INTEGER) AS f) WHERE (i + j) % 3 = f) SELECT g.mat, f, round(sum(CASE WHEN c.mat IS NULL THEN -w ELSE 1 - w END), 6) AS score FROM g LEFT JOIN cells c ON g.mat = c.mat AND g.i = c.i AND g.j = c.j JOIN (SELECT unnest([0, 1, 2]) AS mat, unnest(CAST([0.5, 0.3, 0.2] AS DOUBLE[])) AS w) ws ON ws.mat = g.mat GROUP BY g.mat, f")
def collective_cover(spark, d):
    cells, _ = related(spark, d)
    f = spark.range(K).select(F.col("id").cast("int").alias("f"))
    near = cells.crossJoin(f).filter((F.col("i") + F.col("j")) % 3 == F.col("f")).select("mat", "i", "j", "f")
    shown = near.union(near.select("mat", F.col("i") + 1, "j", "f")).distinct()
    weights = spark.createDataFrame([(0, 0.5), (1, 0.3), (2, 0.2)], "mat int, w double")
    return six(collective.cover(cells, shown, weights), "score")


@query("SELECT round(sum(w * s), 6) AS weighted, round(CASE WHEN min(s) = 0 THEN 0 ELSE count(*) / sum(1 / s) END, 6) AS harmonic FROM (SELECT c_mktsegment, avg(c_acctbal) AS s, CAST(count(*) AS DOUBLE) AS w FROM customer GROUP BY c_mktsegment)")
def weighted_harmonic(spark, d):
    t = read(spark, d, "customer").groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("s"), F.count(F.lit(1)).cast("double").alias("w"))
    return six(metrics.weighted_score(t).withColumnRenamed("score", "weighted").crossJoin(metrics.harmonic_score(t).withColumnRenamed("score", "harmonic")), "weighted", "harmonic")


@query(f"WITH {RUV} SELECT CAST(CASE WHEN a < 0.1 THEN 0 WHEN a >= 0.9 THEN 9 ELSE floor((a - CAST(0.1 AS DOUBLE)) / (CAST(0.9 AS DOUBLE) - CAST(0.1 AS DOUBLE)) * 8) + 1 END AS BIGINT) AS bucket, count(*) AS n FROM uu GROUP BY bucket")
def factor_histogram(spark, d):
    return aggregates.histogram(co.long(factors(ue(spark, d))[0], "i", K), "x", 0.1, 0.9, 8)


# ---- association -------------------------------------------------------------------------------------------------------

ASSOC = "sz AS (SELECT j, count(*) AS n FROM {x} GROUP BY j), assoc AS (SELECT a.j AS p, b.j AS q, count(*) / CAST(any_value(n) AS DOUBLE) AS c FROM {x} a JOIN {x} b USING (i) JOIN sz ON sz.j = a.j GROUP BY a.j, b.j)"
TAU = 0.5


def asso_sql(rounds: int, x: str = "ue", tau: float = TAU, fp: int = 4, fn: int = 6) -> str:
    """CTEs r0 .. of the greedy cover: each has p, gain and the rows of the best candidate."""
    out = [ASSOC.format(x=x), f"bs AS (SELECT p, q AS j FROM assoc WHERE c > CAST({tau} AS DOUBLE))", "bsz AS (SELECT p, count(*) AS n FROM bs GROUP BY p)"]
    covered, used = [], []
    for r in range(rounds):
        cov = " UNION ".join(f"SELECT g{k}.i, bs.j FROM g{k} JOIN bs USING (p)" for k in covered) if covered else f"SELECT i, j FROM {x} WHERE false"
        free = " AND ".join(f"p NOT IN (SELECT p FROM b{k})" for k in used) or "true"
        out.append(f"c{r} AS ({cov})")
        out.append(f"w{r} AS (SELECT i, j, {fp + fn} AS w FROM {x} WHERE (i, j) NOT IN (SELECT (i, j) FROM c{r}) UNION ALL SELECT i, j, {fp} FROM c{r})")
        out.append(f"a{r} AS (SELECT i, bs.p, CAST(sum(w) - {fp} * any_value(n) AS BIGINT) AS gain FROM w{r} JOIN bs USING (j) JOIN bsz ON bsz.p = bs.p WHERE {free.replace('p NOT', 'bs.p NOT')} GROUP BY i, bs.p HAVING sum(w) > {fp} * any_value(n))")
        out.append(f"b{r} AS (SELECT p, sum(gain) AS gain FROM a{r} GROUP BY p ORDER BY gain DESC, p LIMIT 1)")
        out.append(f"g{r} AS (SELECT i, p FROM a{r} WHERE p IN (SELECT p FROM b{r}))")
        covered.append(r)
        used.append(r)
    return ", ".join(out)


@query(f"WITH {UE}, {ASSOC.format(x='ue')} SELECT p, q, round(c, 6) AS c FROM assoc")
def asso_assoc(spark, d):
    return six(greedy.associations(ue(spark, d)), "c")


@query(f"WITH {UE}, r AS (SELECT j AS i, i AS j FROM ue), {ASSOC.format(x='r')} SELECT p, q, round(c, 6) AS c FROM assoc")
def asso_assoc_rows(spark, d):
    return six(greedy.associations(ue(spark, d), "i"), "c")


@query(f"WITH {UE}, {ASSOC.format(x='ue')} SELECT p, q AS j FROM assoc WHERE c > CAST(0.5 AS DOUBLE)")
def asso_basis(spark, d):
    return greedy.basis(greedy.associations(ue(spark, d)), TAU)


@query(f"WITH {UE}, {asso_sql(1)} SELECT i, p, gain FROM a0")
def asso_gain_round1(spark, d):
    x = ue(spark, d)
    return greedy.gains(x, greedy.basis(greedy.associations(x), TAU), greedy.Fit(), 4, 6).withColumn("gain", F.col("gain").cast("bigint"))


def tiles(fit: greedy.Fit) -> DataFrame:
    """f, i, j of all patterns."""
    return fit.u.join(fit.v, "f").select("f", "i", "j")


@query(f"WITH {UE}, {asso_sql(3)} " + " UNION ALL ".join(f"SELECT {k} AS f, g{k}.i, bs.j FROM g{k} JOIN bs USING (p)" for k in range(3)))
def asso_fit_k3(spark, d):
    return tiles(greedy.asso(ue(spark, d), 3, TAU, 4, 6))


@query(f"WITH {UE}, r AS (SELECT j AS i, i AS j FROM ue), {asso_sql(1, 'r')} SELECT 0 AS f, bs.j AS i, g0.i AS j FROM g0 JOIN bs USING (p)")
def asso_transposed(spark, d):
    return tiles(greedy.transposed(greedy.asso, ue(spark, d), 1, TAU, 4, 6))


@query(f"WITH {UV}, o AS (SELECT DISTINCT i, j FROM u JOIN v USING (f) WHERE f <> 0), n AS (SELECT count(*) AS n FROM v WHERE f = 0), w AS (SELECT i, j, 10 AS w FROM ue WHERE (i, j) NOT IN (SELECT (i, j) FROM o) UNION ALL SELECT i, j, 4 FROM o) SELECT i, 0 AS f FROM w, n WHERE j IN (SELECT j FROM v WHERE f = 0) GROUP BY i HAVING sum(w) > 4 * any_value(n)")
def asso_iter_refine(spark, d):
    x = ue(spark, d)
    return greedy.refitted_column(x, patterns(x), 0, 4, 6)


def asso_iter_sql(k: int, rounds: int) -> str:
    """The cover of `asso_sql`, then one pattern after the other fitted anew; a change stays if the error falls, until k in a row did not.
    Rounds after that, of which there are more than enough, change nothing."""
    out = [asso_sql(k), "v0 AS (" + " UNION ALL ".join(f"SELECT {f} AS f, j FROM bs WHERE p IN (SELECT p FROM b{f})" for f in range(k)) + ")", "y0 AS (" + " UNION ALL ".join(f"SELECT {f} AS f, i FROM g{f}" for f in range(k)) + ")"]
    error = lambda u: f"(SELECT count(*) FROM (SELECT DISTINCT i, j FROM {u} JOIN v0 USING (f)) WHERE (i, j) NOT IN (SELECT (i, j) FROM ue)) + (SELECT count(*) FROM ue WHERE (i, j) NOT IN (SELECT (i, j) FROM {u} JOIN v0 USING (f)))"
    out.append(f"z0 AS MATERIALIZED (SELECT {error('y0')} AS e, 0 AS still)")
    for n in range(rounds):
        f = n % k
        out.append(f"x{n} AS MATERIALIZED (SELECT DISTINCT i, j FROM y{n} JOIN v0 USING (f) WHERE f <> {f})")
        out.append(f"q{n} AS (SELECT i, j, 10 AS w FROM ue WHERE (i, j) NOT IN (SELECT (i, j) FROM x{n}) UNION ALL SELECT i, j, 4 FROM x{n})")
        out.append(f"m{n} AS MATERIALIZED (SELECT * FROM y{n} WHERE f <> {f} UNION ALL SELECT {f} AS f, i FROM q{n} WHERE j IN (SELECT j FROM v0 WHERE f = {f}) GROUP BY i HAVING sum(w) > 4 * (SELECT count(*) FROM v0 WHERE f = {f}))")
        out.append(f"d{n} AS MATERIALIZED (SELECT {error(f'm{n}')} AS e)")
        out.append(f"ok{n} AS MATERIALIZED (SELECT d{n}.e < z{n}.e AND still < {k} AS better FROM d{n}, z{n})")
        out.append(f"y{n + 1} AS MATERIALIZED (SELECT * FROM m{n} WHERE (SELECT better FROM ok{n}) UNION ALL SELECT * FROM y{n} WHERE NOT (SELECT better FROM ok{n}))")
        out.append(f"z{n + 1} AS MATERIALIZED (SELECT CASE WHEN better THEN d{n}.e ELSE z{n}.e END AS e, CASE WHEN still >= {k} THEN still WHEN better THEN 0 ELSE still + 1 END AS still FROM d{n}, z{n}, ok{n})")
    return f"WITH {UE}, {', '.join(out)} SELECT f, i, j FROM y{rounds} JOIN v0 USING (f)"


@query(asso_iter_sql(3, 12))
def asso_iter_fit(spark, d):
    x = ue(spark, d)
    return tiles(greedy.asso_iter(x, greedy.asso(x, 3, TAU, 4, 6), 4, 6))


@query(f"WITH {MASKS}, s AS (SELECT unnest(range(8)) AS choice), cm AS (SELECT j, coalesce(mj, 0) AS mj FROM (SELECT DISTINCT j FROM ue) LEFT JOIN mv USING (j)), e AS (SELECT i, choice, CAST(sum(CASE WHEN ((((choice >> 2) & 1) | (((choice >> 1) & 1) << 1) | ((choice & 1) << 2)) & mj) = 0 THEN 0 WHEN x THEN 6 ELSE -4 END) AS BIGINT) AS score FROM (SELECT a.i, cm.mj, (a.i, cm.j) IN (SELECT (i, j) FROM ue) AS x FROM (SELECT DISTINCT i FROM ue) a, cm), s GROUP BY i, choice) SELECT i, choice, score FROM e QUALIFY row_number() OVER (PARTITION BY i ORDER BY score DESC, choice) = 1")
def asso_opt_rows(spark, d):
    x = ue(spark, d)
    return greedy.asso_opt(x, patterns(x), 4, 6).withColumn("score", F.col("score").cast("bigint"))


# ---- concepts ----------------------------------------------------------------------------------------------------------

CONCEPT = f"{UE}, n AS (SELECT j, count(*) AS n FROM ue GROUP BY j), cl AS (SELECT a.j, b.j AS c, count(*) AS k FROM ue a JOIN ue b USING (i) GROUP BY a.j, b.j), st AS (SELECT cl.j, CAST(sum(k) AS BIGINT) AS score FROM cl JOIN n USING (j) WHERE k = n GROUP BY cl.j)"


@query(f"WITH {CONCEPT} SELECT j, score FROM st")
def grecond_step1(spark, d):
    x = ue(spark, d)
    return greedy.concept_step(x, greedy.cells(x, greedy.Fit()), None, []).select("j", "score")


def concept_sql(f: int, steps: int) -> list[str]:
    """r{f}_{steps} and c{f}_{steps}: rows and columns of the concept of open cells o{f}, grown by up to `steps` columns; a step that gains
    nothing leaves all as it is."""
    out = [f"r{f}_0 AS (SELECT DISTINCT i FROM ue)", f"c{f}_0 AS (SELECT j FROM ue WHERE false)", f"s{f}_0 AS (SELECT 0 AS s)"]
    for n in range(steps):
        x, y = f"{f}_{n}", f"{f}_{n + 1}"
        out.append(f"in{x} AS MATERIALIZED (SELECT * FROM o{f} WHERE i IN (SELECT i FROM r{x}))")
        out.append(f"n{x} AS (SELECT j AS a, count(*) AS n, bool_or(op) AS op FROM in{x} GROUP BY j)")
        out.append(f"p{x} AS MATERIALIZED (SELECT a, b, r FROM (SELECT p.j AS a, q.j AS b, count(*) AS k, sum(CAST(q.op AS BIGINT)) AS r FROM in{x} p JOIN in{x} q USING (i) GROUP BY p.j, q.j) JOIN n{x} USING (a) WHERE k = n AND op AND a NOT IN (SELECT j FROM c{x}))")
        out.append(f"b{x} AS MATERIALIZED (SELECT a, sum(r) AS s FROM p{x} GROUP BY a HAVING sum(r) > (SELECT s FROM s{x}) ORDER BY s DESC, a LIMIT 1)")
        out.append(f"r{y} AS MATERIALIZED (SELECT i FROM r{x} WHERE NOT EXISTS (SELECT 1 FROM b{x}) OR i IN (SELECT i FROM in{x} WHERE j IN (SELECT a FROM b{x})))")
        out.append(f"c{y} AS MATERIALIZED (SELECT b AS j FROM p{x} WHERE a IN (SELECT a FROM b{x}) UNION ALL SELECT j FROM c{x} WHERE NOT EXISTS (SELECT 1 FROM b{x}))")
        out.append(f"s{y} AS (SELECT coalesce((SELECT s FROM b{x}), s) AS s FROM s{x})")
    return out


def grecond_sql(k: int, steps: int = 4) -> str:
    """Concepts one after the other."""
    out = [UE, "o0 AS (SELECT i, j, true AS op FROM ue)"]
    for f in range(k):
        out += concept_sql(f, steps)
        out.append(f"t{f} AS MATERIALIZED (SELECT {f} AS f, i, j FROM r{f}_{steps}, c{f}_{steps})")
        out.append(f"o{f + 1} AS MATERIALIZED (SELECT i, j, op AND (i, j) NOT IN (SELECT (i, j) FROM t{f}) AS op FROM o{f})")
    return f"WITH {', '.join(out)} " + " UNION ALL ".join(f"SELECT * FROM t{f}" for f in range(k))


def grecond_plus_sql(w_fp: int, w_fn: int, steps: int = 4) -> str:
    """Two concepts, each grown line by line, the best one first; then the first one goes if it lies within the second, and so do added
    lines that the other one covers. Lines are numbered by id, sets of them are lists."""
    numbered = UE.replace("ue AS", "raw AS", 1) + ", ri AS MATERIALIZED (SELECT i AS id, row_number() OVER (ORDER BY i) AS i FROM (SELECT DISTINCT i FROM raw)), rj AS MATERIALIZED (SELECT j AS id, row_number() OVER (ORDER BY j) AS j FROM (SELECT DISTINCT j FROM raw))"
    out = [numbered, "ue AS MATERIALIZED (SELECT ri.i, rj.j FROM raw JOIN ri ON ri.id = raw.i JOIN rj ON rj.id = raw.j)", "pd0 AS (SELECT i, j FROM ue WHERE false)", "o0 AS (SELECT i, j, true AS op FROM ue)"]
    for f in range(2):
        out += concept_sql(f, steps)
        for key, other in (("i", "j"), ("j", "i")):
            out.append(
                f"l{key}{f} AS MATERIALIZED (SELECT list({{'{key}': o.{key}, 'has': has, 'cov': coalesce(cov, [])}}) AS l{key} FROM (SELECT {key}, list({other}) AS has FROM o{f} WHERE op GROUP BY {key}) o"
                f" LEFT JOIN (SELECT {key}, list({other}) AS cov FROM pd{f} GROUP BY {key}) c ON c.{key} = o.{key})"
            )
        gains = [
            f"[{{'loss': {w_fp} * (len({across}) - len(list_intersect({across}, y.has)) - len(list_intersect({across}, y.cov))) - {w_fn} * len(list_intersect({across}, y.has)), 'axis': {axis}, 'line': y.{key}}}"
            f" FOR y IN l{key} IF NOT list_contains({own}, y.{key})]"
            for axis, key, own, across in ((0, "i", "r", "s"), (1, "j", "s", "r"))
        ]
        out.append(f"st{f} AS MATERIALIZED (SELECT * FROM (SELECT list(i) AS r FROM r{f}_{steps}), (SELECT list(j) AS s FROM c{f}_{steps}) WHERE s IS NOT NULL)")
        out.append(
            f"ex{f} AS (SELECT 0 AS n, r, s FROM st{f} UNION ALL"
            f" SELECT n + 1, CASE WHEN b.axis = 0 THEN list_append(r, b.line) ELSE r END, CASE WHEN b.axis = 1 THEN list_append(s, b.line) ELSE s END"
            f" FROM (SELECT n, r, s, list_min(list_concat({gains[0]}, {gains[1]})) AS b FROM ex{f}, li{f}, lj{f}) WHERE b.loss < 0)"
        )
        out.append(f"la{f} AS MATERIALIZED (SELECT r, s FROM ex{f} ORDER BY n DESC LIMIT 1)")
        out.append(f"pd{f + 1} AS MATERIALIZED (SELECT i, unnest(s) AS j FROM (SELECT unnest(r) AS i, s FROM la{f}))")
        out.append(f"o{f + 1} AS MATERIALIZED (SELECT i, j, op AND (i, j) NOT IN (SELECT (i, j) FROM pd{f + 1}) AS op FROM o{f})")
    within = lambda a, b: f"len(list_intersect({a}, {b})) = len({a})"
    out.append("wi AS MATERIALIZED (SELECT list({'i': i, 'a': a}) AS wi FROM (SELECT i, list(j) AS a FROM ue GROUP BY i))")
    out.append("wj AS MATERIALIZED (SELECT list({'j': j, 'a': a}) AS wj FROM (SELECT j, list(i) AS a FROM ue GROUP BY j))")
    both = "SELECT a.r AS r0, a.s AS s0, coalesce(b.r, []) AS r1, coalesce(b.s, []) AS s1, p.r AS fr0, p.s AS fs0, coalesce(q.r, []) AS fr1, coalesce(q.s, []) AS fs1 FROM la0 a CROSS JOIN st0 p LEFT JOIN la1 b ON true LEFT JOIN st1 q ON true"
    out.append(f"z0 AS MATERIALIZED (SELECT * REPLACE (CASE WHEN {within('r0', 'r1')} AND {within('s0', 's1')} THEN [] ELSE r0 END AS r0) FROM ({both}))")
    order = [(0, "r", "s", "i"), (0, "s", "r", "j"), (1, "r", "s", "i"), (1, "s", "r", "j")]
    for n, (f, own, across, key) in enumerate(order):
        a, b, c, d = f"{own}{f}", f"{across}{f}", f"{own}{1 - f}", f"{across}{1 - f}"
        # the other pattern covers an added line, all cells of which are ones
        gone = f"[y.{key} FOR y IN w{key} IF NOT list_contains(f{a}, y.{key}) AND list_contains({c}, y.{key}) AND len({b}) > 0 AND {within(b, d)} AND {within(b, 'y.a')}]"
        out.append(f"z{n + 1} AS MATERIALIZED (SELECT * EXCLUDE (gone) REPLACE ([y FOR y IN {a} IF NOT list_contains(gone, y)] AS {a}) FROM (SELECT z{n}.*, {gone} AS gone FROM z{n}, w{key}))")
    tiles = " UNION ALL ".join(f"SELECT {f} AS f, i, unnest(s) AS j FROM (SELECT unnest(r{f}) AS i, s{f} AS s FROM z4)" for f in range(2))
    return f"WITH RECURSIVE {', '.join(out)} SELECT CAST(f AS INTEGER) AS f, ri.id AS i, rj.id AS j FROM ({tiles}) t JOIN ri USING (i) JOIN rj USING (j)"


@query(grecond_sql(3))
def grecond_fit_k3(spark, d):
    return tiles(greedy.grecond(ue(spark, d), 3))


@query(grecond_plus_sql(2, 8))
def grecond_plus_fit_k2(spark, d):
    return tiles(greedy.grecond_plus(ue(spark, d), 2, 0, 2, 8))


@query(grecond_plus_sql(3, 4))
def grecond_plus_fit_dear(spark, d):
    """The same where a wrong cell costs three quarters of a missed one, so that growth ends before the whole matrix."""
    return tiles(greedy.grecond_plus(ue(spark, d), 2, 0, 3, 4))


def seeds(x: BoolMatrix) -> tuple[DataFrame, DataFrame]:
    """Rows and columns of a tile by hash."""
    return x.rows.filter(uniform("t", F.col("i")) < 0.2), x.cols.filter(uniform("t", F.col("j")) < 0.2)


TILE = f"{UV}, tr AS (SELECT i FROM (SELECT DISTINCT i FROM ue) WHERE {uni('t', 'i')} < CAST(0.2 AS DOUBLE)), tc AS (SELECT j FROM (SELECT DISTINCT j FROM ue) WHERE {uni('t', 'j')} < CAST(0.2 AS DOUBLE)), op AS (SELECT i, j, (i, j) IN (SELECT (i, j) FROM ue) AS one FROM (SELECT a.i, b.j FROM (SELECT DISTINCT i FROM ue) a, (SELECT DISTINCT j FROM ue) b EXCEPT SELECT i, j FROM pd))"


@query(f"WITH {TILE} SELECT 'row' AS axis, CAST(i AS VARCHAR) AS id, CAST(sum(CASE WHEN one THEN 8 ELSE -2 END) AS BIGINT) AS gain FROM op WHERE j IN (SELECT j FROM tc) AND i NOT IN (SELECT i FROM tr) GROUP BY i HAVING bool_or(one) UNION ALL SELECT 'col', j, CAST(sum(CASE WHEN one THEN 8 ELSE -2 END) AS BIGINT) FROM op WHERE i IN (SELECT i FROM tr) AND j NOT IN (SELECT j FROM tc) GROUP BY j HAVING bool_or(one)")
def greconp_expand_step(spark, d):
    x = ue(spark, d)
    return greedy.line_gains(x, patterns(x), *seeds(x), 2, 8).select("axis", "id", F.col("gain").cast("bigint").alias("gain"))


NESTED = f"{UE}, nu AS (SELECT i, f FROM (SELECT DISTINCT i FROM ue), (SELECT CAST(unnest(range(5)) AS INTEGER) AS f) WHERE i % (f + 1) = 0), nv AS (SELECT j, f FROM (SELECT j, row_number() OVER (ORDER BY j) - 1 AS o FROM (SELECT DISTINCT j FROM ue)), (SELECT CAST(unnest(range(5)) AS INTEGER) AS f) WHERE o % (f + 1) = 0)"


def nested(spark, d):
    x = ue(spark, d)
    f = spark.range(5).select(F.col("id").cast("int").alias("f"))
    u = x.rows.crossJoin(f).filter(F.col("i") % (F.col("f") + 1) == 0)
    return x, u, factorized(x.cols, "j").crossJoin(f).filter(F.col("ord") % (F.col("f") + 1) == 0).select("j", "f")


@query(f"WITH {NESTED} SELECT f FROM (SELECT f, bool_and(i IN (SELECT i FROM nu WHERE f = 1)) AS a FROM nu WHERE f <> 1 GROUP BY f) JOIN (SELECT f, bool_and(j IN (SELECT j FROM nv WHERE f = 1)) AS b FROM nv WHERE f <> 1 GROUP BY f) USING (f) WHERE a AND b")
def greconp_remove_covered(spark, d):
    _, u, v = nested(spark, d)
    return greedy.contained(u, v, 1)


@query(f"WITH {NESTED}, ti AS (SELECT nu.i, nv.j, count(*) AS t FROM nu JOIN nv USING (f) GROUP BY ALL), own AS (SELECT a.i, b.j, t >= 2 AND (a.i, b.j) IN (SELECT (i, j) FROM ue) AS good FROM (SELECT i FROM nu WHERE f = 3) a, (SELECT j FROM nv WHERE f = 3) b, ti WHERE ti.i = a.i AND ti.j = b.j) SELECT 'row' AS axis, CAST(i AS VARCHAR) AS id FROM own GROUP BY i HAVING bool_and(good) UNION ALL SELECT 'col', CAST(j AS VARCHAR) FROM own GROUP BY j HAVING bool_and(good)")
def greconp_remove_overlapped(spark, d):
    x, u, v = nested(spark, d)
    return greedy.needless_lines(x, u, v, 3)


# ---- itemsets ----------------------------------------------------------------------------------------------------------

SETS = f"{UE}, m AS (SELECT count(DISTINCT i) AS m FROM ue), f1 AS (SELECT j FROM ue GROUP BY j HAVING count(*) >= 0.5 * (SELECT m FROM m)), t AS (SELECT i, j FROM ue JOIN f1 USING (j)), f2 AS (SELECT a.j AS a, b.j AS b FROM t a JOIN t b ON a.i = b.i AND a.j < b.j GROUP BY ALL HAVING count(*) >= 0.5 * (SELECT m FROM m)), cd AS (SELECT DISTINCT j AS c, j FROM ue UNION ALL SELECT a || '+' || b, unnest([a, b]) FROM f2), cz AS (SELECT c, count(*) AS size FROM cd GROUP BY c), hy AS (SELECT c, i, any_value(size) AS size, count(*) AS r FROM ue JOIN cd USING (j) JOIN cz USING (c) GROUP BY c, i HAVING count(*) = any_value(size))"


@query(f"WITH {SETS} SELECT c, j FROM cd")
def hyper_itemsets(spark, d):
    return greedy.itemsets(ue(spark, d), 0.5)


@query(f"WITH {SETS} SELECT c, i, r FROM hy")
def hyper_find(spark, d):
    x = ue(spark, d)
    return greedy.hyper_candidates(x, greedy.itemsets(x, 0.5), greedy.cells(x, greedy.Fit())).select("c", "i", "r")


@query(f"WITH {SETS} SELECT c, count(*) AS rows, round((count(*) + max(size)) / CAST(sum(r) AS DOUBLE), 6) AS cost FROM hy GROUP BY c")
def hyper_cost(spark, d):
    x = ue(spark, d)
    return six(greedy.hyper_costs(greedy.hyper_candidates(x, greedy.itemsets(x, 0.5), greedy.cells(x, greedy.Fit()))), "cost")


def hyper_sql(rounds: int) -> str:
    out = [SETS, "fl AS (SELECT c, i FROM ue JOIN cd USING (j) JOIN cz USING (c) GROUP BY c, i HAVING count(*) = any_value(size))", "cov0 AS (SELECT i, j FROM ue WHERE false)"]
    for r in range(rounds):
        out.append(f"rr{r} AS (SELECT fl.c, fl.i, count(*) AS r FROM fl JOIN cd USING (c) WHERE (fl.i, cd.j) NOT IN (SELECT (i, j) FROM cov{r}) GROUP BY fl.c, fl.i)")
        out.append(f"b{r} AS (SELECT c FROM (SELECT c, (count(*) + any_value(size)) / CAST(sum(r) AS DOUBLE) AS cost FROM rr{r} JOIN cz USING (c) GROUP BY c) ORDER BY cost, c LIMIT 1)")
        out.append(f"t{r} AS (SELECT {r} AS f, rr{r}.i, cd.j FROM rr{r} JOIN b{r} USING (c) JOIN cd USING (c))")
        out.append(f"cov{r + 1} AS (SELECT i, j FROM cov{r} UNION SELECT i, j FROM t{r})")
    return f"WITH {', '.join(out)} " + " UNION ALL ".join(f"SELECT * FROM t{r}" for r in range(rounds))


@query(hyper_sql(3))
def hyper_fit_k3(spark, d):
    return tiles(greedy.hyper(ue(spark, d), 0.5, k=3))


MERGE = f"{UV}, pr AS (SELECT x.f AS a, y.f AS b FROM fs x, fs y WHERE x.f < y.f), si AS (SELECT DISTINCT a, b, i FROM pr JOIN u ON u.f IN (a, b)), sj AS (SELECT DISTINCT a, b, j FROM pr JOIN v ON v.f IN (a, b)), sz AS (SELECT f, sum(n) AS n FROM (SELECT f, count(*) AS n FROM u GROUP BY f UNION ALL SELECT f, count(*) FROM v GROUP BY f) GROUP BY f), mm AS (SELECT a, b, count(*) AS cells, sum(CAST((i, j) IN (SELECT (i, j) FROM pd) AS BIGINT)) AS cov, sum(CAST((i, j) IN (SELECT (i, j) FROM ue) AS BIGINT)) AS ones FROM si JOIN sj USING (a, b) GROUP BY a, b)"
SAVED = "CAST(p.n + q.n - (SELECT count(*) FROM si WHERE si.a = mm.a AND si.b = mm.b) - (SELECT count(*) FROM sj WHERE sj.a = mm.a AND sj.b = mm.b) AS DOUBLE) / (cells - cov)"


@query(f"WITH {MERGE} SELECT a, b, round({SAVED}, 6) AS savings, CAST(cells - ones AS BIGINT) AS fp FROM mm JOIN sz p ON p.f = a JOIN sz q ON q.f = b")
def hyperplus_merge(spark, d):
    x = ue(spark, d)
    fit = patterns(x)
    f = spark.range(K).select(F.col("id").cast("int").alias("f"))
    pairs = f.select(F.col("f").alias("a")).join(f.select(F.col("f").alias("b")), F.col("a") < F.col("b"))
    return six(greedy.merge_savings(x, fit.u, fit.v, pairs), "savings")


@query(f"WITH {MERGE}, best AS (SELECT a, b FROM (SELECT a, b, CASE WHEN cells = cov THEN CAST('infinity' AS DOUBLE) ELSE {SAVED} END AS s FROM mm JOIN sz p ON p.f = a JOIN sz q ON q.f = b) ORDER BY s DESC, a, b LIMIT 1), nu AS (SELECT DISTINCT i, CAST(CASE WHEN f = a OR f = b THEN 3 ELSE f END AS INTEGER) AS f FROM u, best), nv AS (SELECT DISTINCT j, CAST(CASE WHEN f = a OR f = b THEN 3 ELSE f END AS INTEGER) AS f FROM v, best) SELECT f, i, j FROM nu JOIN nv USING (f)")
def hyper_plus_fit(spark, d):
    x = ue(spark, d)
    return tiles(greedy.hyper_plus(x, patterns(x), 2, samples=10, seed=1))


# ---- cores, extensions, medians ----------------------------------------------------------------------------------------

OPEN = f"{MASKS}, op AS (SELECT i, j FROM ue EXCEPT SELECT i, j FROM pd)"


def open_cells(spark, d):
    x = ue(spark, d)
    return greedy.cells(x, patterns(x))


@query(f"WITH {OPEN} SELECT j, count(*) AS score FROM op GROUP BY j")
def panda_sort_frequency(spark, d):
    return greedy.item_order(open_cells(spark, d), "frequency")


@query(f"WITH {OPEN}, n AS (SELECT i, count(*) AS n FROM op GROUP BY i) SELECT j, CAST(sum(n) - count(*) AS BIGINT) AS score FROM op JOIN n USING (i) GROUP BY j")
def panda_sort_couples(spark, d):
    return greedy.item_order(open_cells(spark, d), "couples-frequency")


@query(f"WITH {OPEN} SELECT j, count(*) AS score FROM op WHERE {uni('t', 'i')} < CAST(0.2 AS DOUBLE) GROUP BY j")
def panda_sort_correlation(spark, d):
    return greedy.item_order(open_cells(spark, d), "correlation", seeds(ue(spark, d))[0])


@query(f"WITH {TILE}, a AS (SELECT j, CAST(1 + sum(CASE WHEN one THEN -3 ELSE 2 END) AS BIGINT) AS cost FROM op WHERE i IN (SELECT i FROM tr) GROUP BY j) SELECT j, coalesce(cost, 1) AS cost FROM (SELECT DISTINCT j FROM ue) LEFT JOIN a USING (j)")
def panda_extend_columns(spark, d):
    x = ue(spark, d)
    rows = seeds(x)[0]
    return greedy.panda_item_costs(x, patterns(x), rows, rows.count(), None, 1, 2, 3).withColumn("cost", F.col("cost").cast("bigint"))


@query(f"WITH {TILE}, a AS (SELECT i, CAST(1 + sum(CASE WHEN one THEN -3 ELSE 2 END) AS BIGINT) AS cost FROM op WHERE j IN (SELECT j FROM tc) GROUP BY i) SELECT i, coalesce(cost, 1) AS cost FROM (SELECT DISTINCT i FROM ue WHERE i NOT IN (SELECT i FROM tr)) LEFT JOIN a USING (i)")
def panda_extend_rows(spark, d):
    x = ue(spark, d)
    rows, cols = seeds(x)
    return greedy.panda_row_costs(x, patterns(x), rows, cols, cols.count(), 1, 2, 3).withColumn("cost", F.col("cost").cast("bigint"))


def panda_sql(k: int) -> str:
    """Each pattern in one walk over the items in order for the core and one for the extension; sets are lists. Pattern f stays
    if the error does not rise, and patterns after one that goes, or that leaves no open one, are empty."""
    out = [UE, "pd0 AS (SELECT i, j FROM ue WHERE false)", "k0 AS (SELECT count(*) AS e, true AS go FROM ue)"]
    for f in range(k):
        out.append(f"op{f} AS MATERIALIZED (SELECT i, j FROM ue, k{f} WHERE go AND (i, j) NOT IN (SELECT (i, j) FROM pd{f}))")
        out.append(f"it{f} AS MATERIALIZED (SELECT o.j, has, coalesce(cov, []) AS cov, row_number() OVER (ORDER BY len(has) DESC, o.j) AS n FROM (SELECT j, list(i) AS has FROM op{f} GROUP BY j) o LEFT JOIN (SELECT j, list(i) AS cov FROM pd{f} GROUP BY j) c ON c.j = o.j)")
        out.append(f"li{f} AS MATERIALIZED (SELECT list({{'i': o.i, 'has': has, 'cov': coalesce(cov, [])}}) AS l FROM (SELECT i, list(j) AS has FROM op{f} GROUP BY i) o LEFT JOIN (SELECT i, list(j) AS cov FROM pd{f} GROUP BY i) c ON c.i = o.i)")
        taken = "1 + len(common) - len(r) - ((len(s) + 1) * len(common) - len(s) * len(r)) <= 0"
        out.append(
            f"co{f} AS (SELECT n, has AS r, [j] AS s FROM it{f} WHERE n = 1 UNION ALL SELECT n, CASE WHEN {taken} THEN common ELSE r END, CASE WHEN {taken} THEN list_append(s, j) ELSE s END"
            f" FROM (SELECT it{f}.n, r, s, j, list_intersect(r, has) AS common FROM co{f} JOIN it{f} ON it{f}.n = co{f}.n + 1))"
        )
        out.append(f"fi{f} AS MATERIALIZED (SELECT r, s FROM co{f} ORDER BY n DESC LIMIT 1)")
        out.append(f"re{f} AS MATERIALIZED (SELECT j, has, cov, row_number() OVER (ORDER BY n) AS n FROM it{f}, fi{f} WHERE NOT list_contains(s, j))")
        cost = "1 + len({own}) - len(list_intersect({own}, {x}cov)) - 2 * len(list_intersect({own}, {x}has))"
        out.append(
            f"ex{f} AS (SELECT CAST(0 AS BIGINT) AS n, r, s FROM fi{f} UNION ALL"
            f" SELECT n, CASE WHEN joins THEN list_concat(r, [y.i FOR y IN l IF NOT list_contains(r, y.i) AND {cost.format(own='t', x='y.')} <= 0]) ELSE r END, CASE WHEN joins THEN t ELSE s END"
            f" FROM (SELECT re{f}.n, r, s, l, list_append(s, j) AS t, {cost.format(own='r', x='')} <= 0 AS joins FROM ex{f} JOIN re{f} ON re{f}.n = ex{f}.n + 1, li{f}))"
        )
        out.append(f"la{f} AS MATERIALIZED (SELECT r, s FROM ex{f} ORDER BY n DESC LIMIT 1)")
        out.append(f"tr{f} AS MATERIALIZED (SELECT i, unnest(s) AS j FROM (SELECT unnest(r) AS i, s FROM la{f}))")
        out.append(f"w{f} AS MATERIALIZED (SELECT i, j FROM pd{f} UNION SELECT i, j FROM tr{f})")
        out.append(f"e{f} AS MATERIALIZED (SELECT (SELECT count(*) FROM (SELECT i, j FROM w{f} EXCEPT SELECT i, j FROM ue)) AS wrong, (SELECT count(*) FROM (SELECT i, j FROM ue EXCEPT SELECT i, j FROM w{f})) AS open)")
        out.append(f"y{f} AS MATERIALIZED (SELECT go AND wrong + open <= e AND EXISTS (SELECT 1 FROM tr{f}) AS stays FROM k{f}, e{f})")
        out.append(f"t{f} AS MATERIALIZED (SELECT CAST({f} AS INTEGER) AS f, i, j FROM tr{f}, y{f} WHERE stays)")
        out.append(f"pd{f + 1} AS MATERIALIZED (SELECT i, j FROM pd{f} UNION SELECT i, j FROM t{f})")
        out.append(f"k{f + 1} AS MATERIALIZED (SELECT CASE WHEN stays THEN wrong + open ELSE e END AS e, stays AND open > 0 AS go FROM k{f}, e{f}, y{f})")
    return f"WITH RECURSIVE {', '.join(out)} " + " UNION ALL ".join(f"SELECT * FROM t{f}" for f in range(k))


@query(panda_sql(2))
def panda_fit_k2(spark, d):
    return tiles(greedy.panda(ue(spark, d), 2))


def mebf_sql(axis: int) -> str:
    k, o = ("j", "i") if axis == 0 else ("i", "j")
    return f"WITH {OPEN}, s AS (SELECT {k}, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {k}) - 1 AS rk FROM op GROUP BY {k}), md AS (SELECT {k} FROM s WHERE rk = (SELECT count(*) // 2 FROM s)), a AS (SELECT {o} FROM op WHERE {k} IN (SELECT {k} FROM md)) SELECT CAST({k} AS VARCHAR) AS id FROM op WHERE {o} IN (SELECT {o} FROM a) GROUP BY {k} HAVING count(*) > CAST(0.5 AS DOUBLE) * (SELECT count(*) FROM a)"


@query(mebf_sql(0))
def mebf_factor_axis0(spark, d):
    return greedy.median_factor(open_cells(spark, d), 0, 0.5)[1].select(F.col("j").cast("string").alias("id"))


@query(mebf_sql(1))
def mebf_factor_axis1(spark, d):
    return greedy.median_factor(open_cells(spark, d), 1, 0.5)[0].select(F.col("i").cast("string").alias("id"))


@query(f"WITH {OPEN}, s AS (SELECT j, count(*) AS n FROM op GROUP BY j ORDER BY n DESC, j LIMIT 2), a AS (SELECT i FROM op WHERE j IN (SELECT j FROM s) GROUP BY i HAVING count(*) = 2) SELECT j FROM op WHERE i IN (SELECT i FROM a) GROUP BY j HAVING count(*) > CAST(0.5 AS DOUBLE) * (SELECT count(*) FROM a)")
def mebf_weak(spark, d):
    return greedy.weak_factor(open_cells(spark, d), 0, 0.5)[1]


def mebf_fit_sql(k: int) -> str:
    """Each round four tiles, from the middle and from the two fullest lines of both axes: the first kind whose better axis does not err more
    than before; a round without one adds nothing, and neither do later ones."""
    out = [UE, "pd0 AS (SELECT i, j FROM ue WHERE false)", "k0 AS (SELECT count(*) AS e FROM ue)"]
    for f in range(k):
        out.append(f"op{f} AS MATERIALIZED (SELECT i, j FROM ue EXCEPT SELECT i, j FROM pd{f})")
        tried = []
        for kind in (0, 1):
            for axis, (key, other) in enumerate((("j", "i"), ("i", "j"))):
                x = f"{f}_{kind}{axis}"
                out.append(f"l{x} AS (SELECT {key}, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {key}) - 1 AS rk FROM op{f} GROUP BY {key})")
                if kind == 0:
                    out.append(f"a{x} AS MATERIALIZED (SELECT {other} FROM op{f} WHERE {key} IN (SELECT {key} FROM l{x} WHERE rk = (SELECT count(*) // 2 FROM l{x})))")
                else:
                    out.append(f"a{x} AS MATERIALIZED (SELECT {other} FROM op{f} WHERE {key} IN (SELECT {key} FROM l{x} WHERE rk < 2) GROUP BY {other} HAVING count(*) = 2)")
                out.append(f"g{x} AS MATERIALIZED (SELECT {key} FROM op{f} WHERE {other} IN (SELECT {other} FROM a{x}) GROUP BY {key} HAVING count(*) > CAST(0.5 AS DOUBLE) * (SELECT count(*) FROM a{x}))")
                out.append(f"t{x} AS MATERIALIZED (SELECT i, j FROM a{x}, g{x})")
                out.append(f"w{x} AS MATERIALIZED (SELECT i, j FROM pd{f} UNION SELECT i, j FROM t{x})")
                tried.append(f"SELECT {kind} AS kind, {axis} AS axis, (SELECT count(*) FROM (SELECT i, j FROM w{x} EXCEPT SELECT i, j FROM ue)) + (SELECT count(*) FROM (SELECT i, j FROM ue EXCEPT SELECT i, j FROM w{x})) AS e WHERE EXISTS (SELECT 1 FROM t{x})")
        out.append(f"e{f} AS MATERIALIZED ({' UNION ALL '.join(tried)})")
        out.append(f"b{f} AS MATERIALIZED (SELECT e{f}.* FROM e{f}, k{f} WHERE e{f}.e <= k{f}.e AND k{f}.e > 0 ORDER BY kind, e{f}.e, axis LIMIT 1)")
        out.append(f"t{f} AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {f} AS f, i, j FROM t{f}_{kind}{axis} WHERE EXISTS (SELECT 1 FROM b{f} WHERE kind = {kind} AND axis = {axis})" for kind in (0, 1) for axis in (0, 1)) + ")")
        out.append(f"pd{f + 1} AS MATERIALIZED (SELECT i, j FROM pd{f} UNION SELECT i, j FROM t{f})")
        out.append(f"k{f + 1} AS (SELECT coalesce((SELECT e FROM b{f}), e) AS e FROM k{f})")
    return f"WITH {', '.join(out)} " + " UNION ALL ".join(f"SELECT * FROM t{f}" for f in range(k))


@query(mebf_fit_sql(3))
def mebf_fit_k3(spark, d):
    return tiles(greedy.mebf(ue(spark, d), 3, 0.5))


# ---- continuous --------------------------------------------------------------------------------------------------------


def stepped(side: DataFrame, key: str = "j") -> DataFrame:
    return six(co.long(side, key, K), "x")


Y = f"{RUV}, y AS (SELECT i, j, sum(a * b) AS y FROM uu JOIN vv USING (f) GROUP BY i, j)"
NUM = f"{Y}, nn AS (SELECT j, f, sum(a) AS n FROM ue JOIN uu USING (i) GROUP BY j, f)"
FULL = f"{NUM}, dd AS (SELECT j, f, sum(y * a) AS d FROM y JOIN uu USING (i) GROUP BY j, f)"


@query(f"WITH {NUM}, dd AS (SELECT j, f, sum(y * a) AS d FROM ue JOIN y USING (i, j) JOIN uu USING (i) GROUP BY j, f) SELECT j, f, round(b * n / d, 6) AS x FROM vv JOIN nn USING (j, f) JOIN dd USING (j, f)")
def wnmf_fro_step(spark, d):
    x = ue(spark, d)
    u, v = factors(x)
    return stepped(co.wnmf_step(x, v, u, "j", K, "mask"))


@query(f"WITH {FULL} SELECT j, f, round(b * n / d, 6) AS x FROM vv JOIN nn USING (j, f) JOIN dd USING (j, f)")
def nmf_mu_step(spark, d):
    x = ue(spark, d)
    u, v = factors(x)
    return stepped(co.wnmf_step(x, v, u, "j", K, "full"))


@query(f"WITH {NUM}, k AS (SELECT j, f, sum(a / y) AS k FROM ue JOIN y USING (i, j) JOIN uu USING (i) GROUP BY j, f) SELECT j, f, round(b * k / n, 6) AS x FROM vv JOIN nn USING (j, f) JOIN k USING (j, f)")
def wnmf_kl_step(spark, d):
    x = ue(spark, d)
    u, v = factors(x)
    return stepped(co.wnmf_kl_step(x, v, u, "j", K, "mask"))


GRAM = "gm AS (SELECT p.f AS s, q.f AS t, sum(p.a * q.a) AS g FROM uu p JOIN uu q USING (i) GROUP BY p.f, q.f), gg AS (SELECT " + ", ".join(f"max(g) FILTER (s = {s} AND t = {t}) AS g{s}{t}" for s in range(K) for t in range(K)) + " FROM gm)"


def cd_sql() -> str:
    """Each column in turn, by the columns as they are then."""
    out = [NUM, GRAM, "c0 AS (SELECT j, " + ", ".join(f"max(b) FILTER (f = {f}) AS x{f}, coalesce(max(n) FILTER (f = {f}), 0) AS n{f}" for f in range(K)) + " FROM vv LEFT JOIN nn USING (j, f) GROUP BY j)"]
    for f in range(K):
        slope = " + ".join(f"x{t} * g{t}{f}" for t in range(K))
        out.append(f"c{f + 1} AS (SELECT * REPLACE (greatest(x{f} - ({slope} - n{f}) / g{f}{f}, 0) AS x{f}) FROM (SELECT c{f}.*, gg.* FROM c{f}, gg))" if f == 0 else f"c{f + 1} AS (SELECT * REPLACE (greatest(x{f} - ({slope} - n{f}) / g{f}{f}, 0) AS x{f}) FROM c{f})")
    return f"WITH {', '.join(out)} " + " UNION ALL ".join(f"SELECT j, {f} AS f, round(x{f}, 6) AS x FROM c{K}" for f in range(K))


@query(cd_sql())
def nmf_cd_step(spark, d):
    x = ue(spark, d)
    u, v = factors(x)
    return stepped(co.cd_step(x, v, u, "j", K))


@query()
def nmf_fit(spark, d):
    u, v, _ = co.nmf(ue(spark, d), K, method="nndsvd", max_iter=1000, converged=1e-4, every=10)
    return stepped(v)


@query(f"WITH {FULL} SELECT j, f, round(b * (n + 6 * b * b) / (d + 4 * b * b * b + 2 * b), 6) AS x FROM vv JOIN nn USING (j, f) JOIN dd USING (j, f)")
def penalty_step(spark, d):
    x = ue(spark, d)
    u, v = factors(x)
    return stepped(co.penalty_step(x, v, u, "j", K, 2.0, "full"))


@query(f"WITH {Y} SELECT round((SELECT sum(pow(CAST(e.i IS NOT NULL AS DOUBLE) - y, 2)) / 2 FROM y LEFT JOIN ue e ON y.i = e.i AND y.j = e.j), 6) AS rec, round((SELECT sum(pow(a * a - a, 2)) / 2 FROM uu), 6) AS reg")
def penalty_error(spark, d):
    x = ue(spark, d)
    u, v = factors(x)
    rec = co.frobenius_error(x, u, v, K, "full")
    return u.agg(F.round(F.lit(rec), 6).alias("rec"), F.round(co.binary_error(u, K), 6).alias("reg")).select("rec", "reg")


@query(f"WITH {Y}, sg AS (SELECT y.i, y.j, e.i IS NOT NULL AS one, 1 / (1 + exp(-10 * (y - 0.5))) AS s FROM y LEFT JOIN ue e ON y.i = e.i AND y.j = e.j), t AS (SELECT j, f, sum(CASE WHEN one THEN s * (1 - s) * a ELSE 0 END) AS n, sum(s * s * (1 - s) * a) AS d FROM sg JOIN uu USING (i) GROUP BY j, f) SELECT j, f, round(b * (10 * n + 6 * b * b) / (10 * d + 4 * b * b * b + 2 * b), 6) AS x FROM vv JOIN t USING (j, f)")
def pnlpf_step(spark, d):
    x = ue(spark, d)
    u, v = factors(x)
    return stepped(co.pnlpf_step(x, v, u, "j", K, 2.0, 10.0))


SOFT = f"{UE}, {FS}, uu AS (SELECT i, f, 1 / (1 + exp(-10 * ({uni('7:i', 'i', 'f')} - 0.5))) AS a FROM (SELECT DISTINCT i FROM ue), fs), vv AS (SELECT j, f, 1 / (1 + exp(-10 * ({uni('7:j', 'j', 'f')} - 0.6))) AS b FROM (SELECT DISTINCT j FROM ue), fs), y AS (SELECT i, j, sum(a * b) AS y FROM uu JOIN vv USING (f) GROUP BY i, j), r AS (SELECT y.i, y.j, CAST(e.i IS NOT NULL AS DOUBLE) - y AS r FROM y LEFT JOIN ue e ON y.i = e.i AND y.j = e.j)"


@query(f"WITH {SOFT} SELECT round((SELECT sum(r * r) / 2 FROM r), 6) AS f, round((SELECT sum(r * b * 10 * a * (1 - a)) FROM r JOIN uu USING (i) JOIN vv USING (j, f)), 6) AS du, round((SELECT sum(r * a * 10 * b * (1 - b)) FROM r JOIN uu USING (i) JOIN vv USING (j, f)), 6) AS dv")
def threshold_f_df(spark, d):
    x = ue(spark, d)
    u, v = factors(x)
    f, (du, dv) = co.threshold_value(x, u, v, K, [0.5, 0.6], 10.0), co.threshold_gradient(x, u, v, K, [0.5, 0.6], 10.0)
    return x.rows.agg(*[F.round(F.lit(c), 6).alias(n) for n, c in (("f", f), ("du", du), ("dv", dv))])


GRIDS = [(0.5, 0.5), (0.7, 0.6), (0.9, 0.8)]


@query(f"WITH {RUV}, g AS (SELECT unnest(CAST([0.5, 0.7, 0.9] AS DOUBLE[])) AS at_u, unnest(CAST([0.5, 0.6, 0.8] AS DOUBLE[])) AS at_v), pp AS (SELECT DISTINCT at_u, at_v, i, j FROM g, uu JOIN vv USING (f) WHERE a > at_u AND b > at_v) SELECT at_u, at_v, (SELECT count(*) FROM ue) AS p, count(*) AS q, CAST(sum(CAST((i, j) IN (SELECT (i, j) FROM ue) AS BIGINT)) AS BIGINT) AS tp, (SELECT count(DISTINCT i) * count(DISTINCT j) FROM ue) AS n FROM pp GROUP BY at_u, at_v")
def threshold_grid(spark, d):
    x = ue(spark, d)
    u, v = factors(x)
    return co.threshold_grid(x, u, v, K, GRIDS, x.m * x.n)


F1 = "coalesce(2 * tpr * ppv / nullif(tpr + ppv, 0), 0)"
RATED = "coalesce(CAST(tp AS DOUBLE) / nullif(p, 0), 0) AS tpr, coalesce(CAST(tp AS DOUBLE) / nullif(q, 0), 0) AS ppv"
#: All 6 x 5 thresholds, with their F1.
STEPS = f"gu AS (SELECT g, a0 + (b0 - a0) * g / 6 AS t FROM (SELECT min(a) AS a0, max(a) AS b0 FROM uu), (SELECT unnest(range(6)) AS g)), gv AS (SELECT g, a0 + (b0 - a0) * g / 6 AS t FROM (SELECT min(b) AS a0, max(b) AS b0 FROM vv), (SELECT unnest(range(6)) AS g))"


@query(f"WITH {RUV}, {STEPS}, hits AS (SELECT DISTINCT gu.t AS at_u, gv.t AS at_v, i, j FROM uu JOIN vv USING (f), gu, gv WHERE a > gu.t AND b > gv.t), c AS (SELECT at_u, at_v, count(*) AS q, sum(CAST((i, j) IN (SELECT (i, j) FROM ue) AS BIGINT)) AS tp, (SELECT count(*) FROM ue) AS p FROM hits GROUP BY at_u, at_v) SELECT round(at_u, 6) AS at_u, round(at_v, 6) AS at_v, CAST(q AS BIGINT) AS q, CAST(tp AS BIGINT) AS tp, round({F1}, 6) AS score FROM (SELECT *, {RATED} FROM c)")
def threshold_grid_search(spark, d):
    x = ue(spark, d)
    u, v = factors(x)
    at = [ts.steps(min(a for a, _ in e), max(b for _, b in e), 6) for e in (ts.ranges(u, K), ts.ranges(v, K))]
    found = ts.grid_counts(x, u, v, K, *at).withColumn("score", ts._metric("F1"))
    return six(found.select("at_u", "at_v", "q", "tp", "score"), "at_u", "at_v", "score")


TRIED = f"tr AS (SELECT n, f, au + (bu - au) * {uni('2024', 'n', chr(39) + 'u' + chr(39), 'f')} AS tu, av + (bv - av) * {uni('2024', 'n', chr(39) + 'v' + chr(39), 'f')} AS tv FROM (SELECT unnest(range(30)) AS n), (SELECT f, min(a) AS au, max(a) AS bu FROM uu GROUP BY f) JOIN (SELECT f, min(b) AS av, max(b) AS bv FROM vv GROUP BY f) USING (f))"


@query(f"WITH {RUV}, {TRIED}, hits AS (SELECT DISTINCT n, i, j FROM tr JOIN uu USING (f) JOIN vv USING (f) WHERE a > tu AND b > tv), c AS (SELECT n AS trial, count(*) AS q, sum(CAST((i, j) IN (SELECT (i, j) FROM ue) AS BIGINT)) AS tp, (SELECT count(*) FROM ue) AS p FROM hits GROUP BY n) SELECT trial, CAST(q AS BIGINT) AS q, CAST(tp AS BIGINT) AS tp, round({F1}, 6) AS score FROM (SELECT *, {RATED} FROM c)")
def threshold_trials(spark, d):
    x = ue(spark, d)
    u, v = factors(x)
    found = ts.trial_counts(x, u, v, K, ts.random_trials(spark, u, v, K, 30, True, 2024)).withColumn("score", ts._metric("F1"))
    return six(found.filter("q > 0").select("trial", "q", "tp", "score"), "score")


def sweep_sql() -> str:
    """Each threshold in turn: cells that others cover stay; rows (columns) on from the largest value down; the largest of equal scores."""
    out = [RUV, "w0 AS (SELECT " + ", ".join(f"CAST(0.5 AS DOUBLE) AS {s}{f}" for s in "uv" for f in range(K)) + ", CAST(NULL AS DOUBLE) AS score)", "y AS (SELECT i, j, " + ", ".join(f"max(a) FILTER (f = {f}) AS a{f}, max(b) FILTER (f = {f}) AS b{f}" for f in range(K)) + ", (i, j) IN (SELECT (i, j) FROM ue) AS one FROM uu JOIN vv USING (f) GROUP BY i, j)", "pp AS (SELECT count(*) AS p FROM ue)"]
    for n, (s, f) in enumerate((s, f) for s in "uv" for f in range(K)):
        rest = " OR ".join(f"(a{g} > u{g} AND b{g} > v{g})" for g in range(K) if g != f)
        mine, across = (f"a{f}", f"b{f} > v{f}") if s == "u" else (f"b{f}", f"a{f} > u{f}")
        out.append(f"h{n} AS MATERIALIZED (SELECT {mine} AS val, one, {rest} AS base, {across} AS far FROM y, w{n})")
        out.append(f"g{n} AS (SELECT val, count(*) FILTER (far AND NOT base) AS q, count(*) FILTER (far AND NOT base AND one) AS tp FROM h{n} GROUP BY val)")
        out.append(f"b{n} AS (SELECT count(*) FILTER (base) AS q0, count(*) FILTER (base AND one) AS t0 FROM h{n})")
        out.append(f"t{n} AS (SELECT val AS t, q0 + coalesce(sum(q) OVER w, 0) AS q, t0 + coalesce(sum(tp) OVER w, 0) AS tp, p FROM g{n}, b{n}, pp WINDOW w AS (ORDER BY val DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) UNION ALL SELECT min(val) - 1, any_value(q0) + sum(q), any_value(t0) + sum(tp), any_value(p) FROM g{n}, b{n}, pp)")
        out.append(f"s{n} AS (SELECT t, {F1} AS score FROM (SELECT t, {RATED} FROM t{n}) ORDER BY score DESC, t DESC LIMIT 1)")
        better = f"w{n}.score IS NULL OR s{n}.score > w{n}.score"
        out.append(f"w{n + 1} AS (SELECT w{n}.* REPLACE (CASE WHEN {better} THEN t ELSE {s}{f} END AS {s}{f}, CASE WHEN {better} THEN s{n}.score ELSE w{n}.score END AS score) FROM w{n}, s{n})")
    return f"WITH {', '.join(out)} " + " UNION ALL ".join(f"SELECT '{s}' AS side, {f} AS f, round({s}{f}, 6) AS t, round(score, 6) AS score FROM w{n + 1}" for n, (s, f) in enumerate((s, f) for s in "uv" for f in range(K)))


@query(sweep_sql())
def threshold_sweep(spark, d):
    x = ue(spark, d)
    u, v = factors(x)
    steps = ts.sweep(x, u, v, K, [0.5] * K, [0.5] * K, rounds=1).log  # 2 x K rows
    return six(spark.createDataFrame([(s["side"], s["f"], s["t"], s["score"]) for s in steps], "side string, f int, t double, score double"), "t", "score")


@query(f"WITH {Y}, z AS (SELECT y.i, y.j, CASE WHEN e.i IS NULL THEN -1 ELSE 1 END AS s, y - CAST(0.8 AS DOUBLE) AS y FROM y LEFT JOIN ue e ON y.i = e.i AND y.j = e.j) SELECT f, round(sum(-s * b / (1 + exp(s * y))), 6) AS g, i FROM z JOIN vv USING (j) WHERE f = 1 GROUP BY i, f")
def faststep_df(spark, d):
    x = ue(spark, d)
    u, v = factors(x)
    return six(co.faststep_gradient(x, u, v, K, 0.8, 1)[0], "g").withColumn("f", F.lit(1))


@query(f"WITH {Y}, z AS (SELECT CASE WHEN e.i IS NULL THEN 1 ELSE -1 END * (y - CAST(0.8 AS DOUBLE)) AS z FROM y LEFT JOIN ue e ON y.i = e.i AND y.j = e.j) SELECT round(sum(ln(1 + exp(z))), 6) AS f FROM z")
def faststep_f(spark, d):
    x = ue(spark, d)
    u, v = factors(x)
    return six(co.faststep_loss(x, u, v, 0.8), "f")


@query(f"WITH {EMB} SELECT vec_id, f, round(greatest((CASE WHEN x <= 0.5 THEN x - 0.1 * sign(x) ELSE x - 0.1 * sign(x - 1) + 0.2 END) / CAST(1.2 AS DOUBLE), 0), 6) AS prox, round(0.1 * least(abs(x), abs(x - 1)) + 0.2 * pow(least(abs(x), abs(x - 1)), 2), 6) AS gap FROM emb")
def palm_prox(spark, d):
    x = F.col("x")
    return emb(spark, d).select("vec_id", "f", F.round(prox(x, 0.1, 0.2), 6).alias("prox"), F.round(gap(x, 0.1, 0.2), 6).alias("gap"))


#: The largest eigenvalue of a symmetric 3 x 3 matrix, in closed form.
SPECTRAL = "e1 AS (SELECT *, (g00 + g11 + g22) / 3 AS q FROM gg), e2 AS (SELECT *, sqrt((pow(g00 - q, 2) + pow(g11 - q, 2) + pow(g22 - q, 2) + 2 * (g01 * g01 + g02 * g02 + g12 * g12)) / 6) AS p FROM e1), e3 AS (SELECT q, p, ((g00 - q) * ((g11 - q) * (g22 - q) - g12 * g12) - g01 * (g01 * (g22 - q) - g12 * g02) + g02 * (g01 * g12 - (g11 - q) * g02)) / pow(p, 3) / 2 AS r FROM e2), ev AS (SELECT q + 2 * p * cos(acos(least(1, greatest(-1, r))) / 3) AS l FROM e3)"


@query(f"WITH {FULL}, {GRAM}, {SPECTRAL}, mv AS (SELECT j, f, 1 / (CAST(1.1 AS DOUBLE) * l) AS eta, b - (d - n) / (CAST(1.1 AS DOUBLE) * l) AS x FROM vv JOIN nn USING (j, f) JOIN dd USING (j, f), ev) SELECT j, f, round(greatest((CASE WHEN x <= 0.5 THEN x - CAST(0.01 AS DOUBLE) * eta * sign(x) ELSE x - CAST(0.01 AS DOUBLE) * eta * sign(x - 1) + CAST(0.02 AS DOUBLE) * eta END) / (1 + CAST(0.02 AS DOUBLE) * eta), 0), 6) AS x FROM mv")
def elbmf_step(spark, d):
    x = ue(spark, d)
    u, v = factors(x)
    return stepped(co.palm_step(x, v, u, "j", K, 0.01, 0.02))


FRO = f"{FULL}, gr AS (SELECT sqrt(sum(g * g)) AS l FROM (SELECT sum(p.a * q.a) AS g FROM uu p JOIN uu q USING (i) GROUP BY p.f, q.f)), mv AS (SELECT j, f, b - (d - n) / (CAST(1.1 AS DOUBLE) * l) AS x, 1 / (CAST(1.1 AS DOUBLE) * l) AS eta FROM vv JOIN nn USING (j, f) JOIN dd USING (j, f), gr)"


@query(f"WITH {FRO} SELECT j, f, round(least(greatest(CASE WHEN x <= 0.5 THEN x - CAST(0.01 AS DOUBLE) * eta * sign(x) ELSE x - CAST(0.01 AS DOUBLE) * eta * sign(x - 1) END, 0), 1), 6) AS x FROM mv")
def primp_step(spark, d):
    x = ue(spark, d)
    u, v = factors(x)
    return stepped(co.palm_step(x, v, u, "j", K, 0.01, 0.0, norm="fro", clip="box"))


@query(f"WITH {RUV} SELECT round(sum(CAST(0.1 AS DOUBLE) * least(a, 1 - a) + CAST(0.2 AS DOUBLE) * pow(least(a, 1 - a), 2)), 6) AS gap FROM uu")
def integrality_gap(spark, d):
    u, _ = factors(ue(spark, d))
    return six(u.agg(F.sum(sum((gap(F.col(c), 0.1, 0.2) for c in co.cols(K)), F.lit(0.0))).alias("gap")), "gap")


def flagship(spark, d) -> DataFrame:
    """The first pattern of a greedy cover, and how well it predicts."""
    x = ue(spark, d)
    fit = greedy.asso(x, 1, TAU, 4, 6)
    return metrics.metrics(metrics.factor_counts(x.ones, fit.u, fit.v, x.m * x.n), ("Recall", "Precision", "F1", "TP", "FP"))
