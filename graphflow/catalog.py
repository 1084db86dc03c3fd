"""Queries over the supplied tables, one for each operator, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphflow.functions import colour
from graphflow.operators import clusters as cl
from graphflow.operators import matrix, prune, quality, render, similarity
from graphflow.plans import algorithms
from graphflow.schema import Params
from graphflow.scratch import Scratch
from graphflow.sources import abc, tables

#: Radius and spreads of the part raster's graph.
RADIUS, SIGMA_X, SIGMA_F = 3.0, 4.0, 100.0
BANDS = ("c0", "c1", "c2")

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# What the queries share: graphs, matrices and clusterings, and their SQL.

DIMS = "dims AS (SELECT CAST(floor(sqrt(count(*))) AS BIGINT) AS h, count(*) // CAST(floor(sqrt(count(*))) AS BIGINT) AS w FROM part)"
PIX = f"{DIMS}, pix AS (SELECT p_partkey AS node, p_partkey // h AS x, p_partkey % h AS y, p_retailprice AS c0, CAST(p_size AS DOUBLE) AS c1, CAST(0 AS DOUBLE) AS c2, w, h FROM part, dims WHERE p_partkey < w * h)"
OFFSETS = "offs AS (SELECT a.range AS dx, b.range AS dy FROM range(-3, 4) a, range(-3, 4) b WHERE a.range * a.range + b.range * b.range <= 9)"


def _sq(a: str, b: str) -> str:
    return f"({a} - {b}) * ({a} - {b})"


def _sim(node_p: str = "p.node", node_q: str = "q.node", sigma_x: str = "4.0") -> str:
    gap = " + ".join(_sq(f"p.{c}", f"q.{c}") for c in BANDS)
    return f"""{PIX}, {OFFSETS}, sim AS (SELECT {node_p} AS col, {node_q} AS "row", round(exp(-((dx * dx + dy * dy) / CAST({sigma_x} AS DOUBLE)) - ({gap}) / CAST(100 AS DOUBLE)), 6) AS val
      FROM pix p, offs, pix q WHERE q.x = p.x + dx AND q.y = p.y + dy)"""


FLOW = """flow AS (SELECT CAST(c_nationkey AS BIGINT) AS col, CAST(s_nationkey AS BIGINT) AS "row", CAST(count(*) AS DOUBLE) AS val
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""
EVENTS = """names AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS i FROM (SELECT DISTINCT event_type FROM events)),
  pairs AS (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events),
  evflow AS (SELECT a.i AS col, b.i AS "row", CAST(count(*) AS DOUBLE) AS val FROM pairs JOIN names a ON a.event_type = pairs.event_type JOIN names b ON b.event_type = pairs.next GROUP BY 1, 2)"""
SUPPLIERS = """so AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem),
  sc AS (SELECT a.l_suppkey AS col, b.l_suppkey AS "row", CAST(count(*) AS DOUBLE) AS val FROM so a JOIN so b USING (l_orderkey) GROUP BY 1, 2),
  sup AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY col ORDER BY val DESC, "row") <= 10)"""


def _prepared(graph: str) -> str:
    return f"""ded AS (SELECT col, "row", max(val) AS val FROM {graph} WHERE val > 0 GROUP BY 1, 2),
  looped AS (SELECT col, "row", val FROM ded WHERE "row" <> col UNION ALL SELECT col, col, coalesce(max(val) FILTER ("row" <> col), 1.0) FROM ded GROUP BY col),
  m0 AS MATERIALIZED (SELECT col, "row", val / sum(val) OVER (PARTITION BY col) AS val FROM looped)"""


def _steps(factors: list[str], cutoff: str = "0.0001", select: int = 50) -> str:
    out = []
    for i, a in enumerate(factors, 1):
        out.append(f"""e{i} AS MATERIALIZED (SELECT a.col, m."row", sum(m.val * a.val) AS val FROM m{i - 1} m JOIN {a} a ON m.col = a."row" GROUP BY 1, 2),
  k{i} AS (SELECT col, "row", val, count(*) OVER (PARTITION BY col) AS n0 FROM e{i}),
  s{i} AS (SELECT * FROM k{i} WHERE n0 = 1 OR round(val, 12) >= {cutoff} QUALIFY row_number() OVER (PARTITION BY col ORDER BY round(val, 12) DESC, "row") <= {select}),
  m{i} AS MATERIALIZED (SELECT col, "row", pow(val, 2) / sum(pow(val, 2)) OVER (PARTITION BY col) AS val FROM s{i})""")
    return ",\n  ".join(out)


def _clusters(m: str) -> str:
    return f"""att AS (SELECT col, "row" AS attractor, round(val, 12) >= 0.5 AS strong FROM {m} QUALIFY row_number() OVER (PARTITION BY col ORDER BY round(val, 12) DESC, "row") = 1),
  arcs AS (SELECT col AS a, attractor AS b FROM att UNION SELECT attractor, col FROM att),
  reach(node, r) AS (SELECT a, a FROM arcs UNION SELECT reach.node, arcs.b FROM reach JOIN arcs ON arcs.a = reach.r),
  clus AS (SELECT node, min(r) AS cluster FROM reach GROUP BY node)"""


OUT = 'SELECT col AS c, "row" AS r, round(val, 6) AS v FROM'
SIM = _sim()
K3 = f"{SIM}, {_prepared('sim')}, {_steps(['m0', 'm1', 'm2'])}"
SEGMENTS = f"{PIX}, clus AS (SELECT p_partkey AS node, CAST(p_size // 10 AS BIGINT) AS cluster FROM part, dims WHERE p_partkey < w * h)"


def _entries(m: DataFrame) -> DataFrame:
    return m.select(F.col("col").alias("c"), F.col("row").alias("r"), F.round("val", 6).alias("v"))


def _raster(spark, sf_dir):
    w, h = tables.raster_size(spark, sf_dir)
    return tables.part_raster(spark, sf_dir, w, h), w, h


def _raster_graph(spark, sf_dir) -> DataFrame:
    pixels, w, h = _raster(spark, sf_dir)
    return similarity.image_similarity(pixels, w, h, RADIUS, SIGMA_X, SIGMA_F, BANDS)


def _segments(spark, sf_dir) -> DataFrame:
    """A clustering of the part raster by bands of size, which has boundaries everywhere."""
    w, h = tables.raster_size(spark, sf_dir)
    parts = tables.load(spark, sf_dir, "part").where(F.col("p_partkey") < w * h)
    return parts.select(F.col("p_partkey").alias("node"), F.floor(F.col("p_size") / 10).cast("long").alias("cluster"))


def _stochastic_flow(spark, sf_dir) -> DataFrame:
    return matrix.build(tables.nation_flow(spark, sf_dir), "insert")


def raster_k3(spark: SparkSession, sf_dir: str, steps: int = 3, scratch: Scratch | None = None):
    """The part raster's matrix after a fixed number of flow iterations, and the nodes."""
    scratch = scratch or Scratch(spark)
    m = matrix.build(_raster_graph(spark, sf_dir), "insert")
    return algorithms.mcl(m, Params(force_iter=steps), n=0, scratch=scratch)[0]


# Sources

@_query(f"""WITH {FLOW} SELECT max(greatest(col, r)) + 1 AS n, max(k) AS kmax, CAST(sum(k) AS BIGINT) AS nnz FROM (SELECT col, max("row") AS r, count(*) AS k FROM flow WHERE val > 0 GROUP BY col)""")
def abc_analyse(spark, sf_dir):
    return matrix.analyse(tables.nation_flow(spark, sf_dir))


@_query(f"""WITH {FLOW}, d AS (SELECT max(greatest(col, "row")) + 1 AS n FROM flow) SELECT col + i.range * n AS c, "row" + i.range * n AS r, round(val, 6) AS v FROM flow, d, range(0, 3) i""")
def replicate_diagonal(spark, sf_dir):
    flow = tables.nation_flow(spark, sf_dir)
    return _entries(matrix.replicate_diagonal(flow, abc.analyse_abc(flow)[0], 3))


@_query(f"WITH {FLOW} {OUT} flow")
def abc_round_trip(spark, sf_dir):
    """Edges written as text and read again."""
    scratch = Scratch(spark)
    abc.write_abc(tables.nation_flow(spark, sf_dir), f"{scratch.root}/abc")
    return _entries(abc.read_abc(spark, f"{scratch.root}/abc"))


@_query(f"WITH {FLOW}, {_prepared('flow')} {OUT} m0")
def matrix_round_trip(spark, sf_dir):
    """A matrix stored with its metadata and loaded again."""
    scratch = Scratch(spark)
    m, meta = abc.build_matrix(tables.nation_flow(spark, sf_dir), missing_diagonal="insert")
    abc.save_matrix(m, meta, f"{scratch.root}/matrix")
    loaded, again = abc.load_matrix(spark, f"{scratch.root}/matrix")
    meta.check(again)
    return _entries(loaded)


@_query(f"WITH {SEGMENTS}, low AS (SELECT cluster, min(node) AS m FROM clus GROUP BY cluster) SELECT node, m AS cluster FROM clus JOIN low USING (cluster)")
def clusters_round_trip(spark, sf_dir):
    """Clusters written as lines and read again; their numbers become their smallest nodes."""
    scratch = Scratch(spark)
    abc.write_clusters(_segments(spark, sf_dir), f"{scratch.root}/clusters")
    return abc.read_clusters(spark, f"{scratch.root}/clusters")


# Matrices

@_query("""SELECT CAST(c_nationkey AS BIGINT) AS c, CAST(s_nationkey AS BIGINT) AS r, round(max(l_quantity), 6) AS v
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""")
def dedup(spark, sf_dir):
    load = lambda t: tables.load(spark, sf_dir, t)
    lines = load("lineitem").select("l_orderkey", "l_suppkey", "l_quantity").join(load("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(load("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(load("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return _entries(matrix.dedup(lines.select(F.col("c_nationkey").cast("long").alias("col"), F.col("s_nationkey").cast("long").alias("row"), F.col("l_quantity").alias("val"))))


@_query(f"WITH {FLOW}, {_prepared('flow')} {OUT} looped")
def add_loops(spark, sf_dir):
    return _entries(matrix.add_loops(matrix.dedup(tables.nation_flow(spark, sf_dir)), "insert"))


@_query(f"WITH {FLOW}, {_prepared('flow')} {OUT} m0")
def normalise(spark, sf_dir):
    return _entries(_stochastic_flow(spark, sf_dir))


_PRODUCT = 'SELECT a.col, m."row", sum(m.val * a.val) AS val FROM m0 m JOIN m0 a ON m.col = a."row" GROUP BY 1, 2'


@_query(f"WITH {FLOW}, {_prepared('flow')}, e AS ({_PRODUCT}) {OUT} e")
def multiply(spark, sf_dir):
    m = _stochastic_flow(spark, sf_dir)
    return _entries(matrix.multiply(m, m))


@_query(f"WITH {FLOW}, {_prepared('flow')}, e AS ({_PRODUCT}) {OUT} e")
def multiply_blocked(spark, sf_dir):
    m = _stochastic_flow(spark, sf_dir)
    return _entries(matrix.multiply(m, m, "blocked"))


@_query(f"WITH {FLOW}, {EVENTS}, {_prepared('flow')}, b AS (SELECT * FROM m0 UNION ALL SELECT * FROM evflow), s AS (SELECT col, \"row\", sum(val) AS val FROM b GROUP BY 1, 2) {OUT} s")
def sparse_add(spark, sf_dir):
    return _entries(matrix.add(_stochastic_flow(spark, sf_dir), tables.event_flow(spark, sf_dir)))


@_query(f"""WITH {FLOW}, {_prepared('flow')}, e AS ({_PRODUCT})
  SELECT round(sum((coalesce(a.val, 0) - coalesce(b.val, 0)) * (coalesce(a.val, 0) - coalesce(b.val, 0))), 6) AS ssd FROM m0 a FULL JOIN e b ON a.col = b.col AND a."row" = b."row" """)
def squared_differences(spark, sf_dir):
    m = _stochastic_flow(spark, sf_dir)
    return matrix.squared_differences(m, matrix.multiply(m, m)).select(F.round("ssd", 6).alias("ssd"))


@_query(f"""WITH {FLOW}, once AS (SELECT col, "row", max(val) AS val FROM flow GROUP BY 1, 2), more AS (SELECT col, "row", val + 1 AS val FROM flow)
  SELECT NOT EXISTS ((SELECT col, "row", val FROM flow EXCEPT ALL SELECT * FROM once) UNION ALL (SELECT * FROM once EXCEPT ALL SELECT col, "row", val FROM flow)) AS same,
    NOT EXISTS ((SELECT col, "row", val FROM flow EXCEPT ALL SELECT * FROM more) UNION ALL (SELECT * FROM more EXCEPT ALL SELECT col, "row", val FROM flow)) AS other""")
def equality(spark, sf_dir):
    flow = tables.nation_flow(spark, sf_dir)
    return spark.range(1).select(F.lit(matrix.equal(flow, matrix.dedup(flow))).alias("same"), F.lit(matrix.equal(flow, flow.withColumn("val", F.col("val") + 1))).alias("other"))


@_query(f"""WITH {FLOW} SELECT "row" // 4 AS block, col // 4 AS slice, count(*) AS size FROM flow GROUP BY 1, 2""")
def transpose_blocks(spark, sf_dir):
    return matrix.transpose_blocks(tables.nation_flow(spark, sf_dir), 4)


@_query(f"""WITH {EVENTS}, d AS (SELECT max(i) + 1 AS n FROM names), cells AS (SELECT c.i AS col, r.i AS "row", coalesce(f.val, 0.0) AS val FROM (SELECT DISTINCT col AS i FROM evflow) c CROSS JOIN names r
  LEFT JOIN evflow f ON f.col = c.i AND f."row" = r.i) SELECT col, string_agg(CAST(CAST(val AS BIGINT) AS VARCHAR), ' ' ORDER BY "row") AS line FROM cells GROUP BY col""")
def dense_print(spark, sf_dir):
    flow = tables.event_flow(spark, sf_dir)
    n = tables.load(spark, sf_dir, "events").select("event_type").distinct().count()
    return matrix.dense(flow, n).select("col", F.array_join(F.transform("vals", lambda x: x.cast("long").cast("string")), " ").alias("line"))


# Inflate and prune

_E = f"WITH {FLOW}, {_prepared('flow')}, e AS MATERIALIZED ({_PRODUCT})"


def _expanded(spark, sf_dir):
    m = _stochastic_flow(spark, sf_dir)
    return matrix.multiply(m, m)


@_query(f"""{_E}, k AS (SELECT *, count(*) OVER (PARTITION BY col) AS n0 FROM e), t AS (SELECT * FROM k WHERE n0 = 1 OR round(val, 12) >= 0.04) {OUT} t""")
def prune_cutoff(spark, sf_dir):
    return _entries(prune.thresholded(_expanded(spark, sf_dir), Params(cutoff=0.04)).where("keep"))


@_query(f"""{_E}, w AS (SELECT col, "row", pow(val, 2) AS val FROM e), s AS (SELECT *, avg(val) OVER (PARTITION BY col) AS a, max(val) OVER (PARTITION BY col) AS b, count(*) OVER (PARTITION BY col) AS n0 FROM w),
  t AS (SELECT * FROM s WHERE n0 = 1 OR round(val, 12) >= round(least(greatest(0.9 * a * (1 - 2.0 * (b - a)), 1e-7), b), 12)) {OUT} t""")
def prune_auto(spark, sf_dir):
    return _entries(prune.thresholded(_expanded(spark, sf_dir), Params(auto_prune=True)).where("keep"))


@_query(f"""{_E}, t AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY col ORDER BY round(val, 12) DESC, "row") <= 5) {OUT} t""")
def select_top(spark, sf_dir):
    return _entries(prune.select_top(_expanded(spark, sf_dir), 5))


@_query(f"""{_E}, t AS (SELECT col, "row", pow(val, 1.7) / sum(pow(val, 1.7)) OVER (PARTITION BY col) AS val FROM e) {OUT} t""")
def inflate(spark, sf_dir):
    return _entries(prune.inflate(_expanded(spark, sf_dir), 1.7))


@_query(f"""{_E} SELECT col, count(*) AS k, round(max(val), 6) AS most, round(sum(val * val), 6) AS center, round(CASE WHEN count(*) > 1 THEN (max(val) - sum(val * val)) * count(*) ELSE 0 END, 6) AS chaos FROM e GROUP BY col""")
def column_stats(spark, sf_dir):
    return prune.column_stats(_expanded(spark, sf_dir)).select("col", "k", *(F.round(c, 6).alias(c) for c in ("most", "center", "chaos")))


@_query(f"""{_E}, k AS (SELECT *, count(*) OVER (PARTITION BY col) AS n0 FROM e),
  t AS (SELECT * FROM k WHERE n0 = 1 OR round(val, 12) >= 0.04), s AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY col ORDER BY round(val, 12) DESC, "row") <= 6),
  m AS (SELECT col, "row", pow(val, 2) / sum(pow(val, 2)) OVER (PARTITION BY col) AS val FROM s),
  c AS (SELECT col, count(*) AS k, max(val) AS most, CASE WHEN count(*) > 1 THEN (max(val) - sum(val * val)) * count(*) ELSE 0 END AS chaos FROM m GROUP BY col),
  lost AS (SELECT count(*) AS n FROM (SELECT DISTINCT col FROM e) WHERE col NOT IN (SELECT col FROM t))
  SELECT (SELECT count(*) FROM e) AS in_nnz, CAST(sum(k) AS BIGINT) AS out_nnz, (SELECT count(*) FROM e) - (SELECT count(*) FROM t) AS cutoff, (SELECT count(*) FROM t) - (SELECT count(*) FROM s) AS prune,
    max(k) AS kmax, count(*) FILTER (most > 0.5) AS attractors, count(*) FILTER (chaos < 1e-4) + (SELECT n FROM lost) AS homogen, round(max(chaos), 6) AS chaos FROM c""")
def step_stats(spark, sf_dir):
    return prune.step_stats(_expanded(spark, sf_dir), Params(cutoff=0.04, select=6)).withColumn("chaos", F.round("chaos", 6))


# Flow clustering

@_query(f"WITH {K3} {OUT} m3")
def mcl_k3(spark, sf_dir):
    return _entries(raster_k3(spark, sf_dir))


@_query(f"WITH {SUPPLIERS}, {_prepared('sup')}, {_steps(['m0', 'm0', 'm0'])} {OUT} m3")
def rmcl_k3(spark, sf_dir):
    m = matrix.build(tables.supplier_topk(spark, sf_dir), "insert")
    return _entries(algorithms.rmcl(m, Params(force_iter=3), n=0)[0])


@_query(f"WITH {SUPPLIERS}, {_prepared('sup')}, {_steps(['m0', 'm0', 'm2', 'm2'])} {OUT} m4")
def bmcl_half_k4(spark, sf_dir):
    m = matrix.build(tables.supplier_topk(spark, sf_dir), "insert")
    return _entries(algorithms.bmcl(m, 0.5, Params(force_iter=4), n=0)[0])


@_query(f"WITH {EVENTS}, {_prepared('evflow')}, {_steps(['m0', 'm1', 'm2', 'm3', 'm4', 'm5'])} {OUT} m6")
def event_flow_k6(spark, sf_dir):
    m = matrix.build(tables.event_flow(spark, sf_dir), "insert")
    return _entries(algorithms.mcl(m, Params(force_iter=6), n=0)[0])


def _until(n: int, regular: bool = False, limit: str = "0.0001") -> str:
    """Up to n steps from m0, pure or with m0 as second factor, and the limit mn: a step after the last one passes its predecessor on."""
    go = ["go0 AS (SELECT true AS go)"]
    for i in range(1, n + 1):
        before, live = f"m{i - 1}", f"(SELECT * FROM m{i - 1} WHERE (SELECT go FROM go{i - 1}))"
        more = f"(SELECT go FROM go{i - 1})"
        if regular and i > 10:
            more += f""" AND (SELECT sqrt(sum((coalesce(a.val, 0) - coalesce(b.val, 0)) * (coalesce(a.val, 0) - coalesce(b.val, 0)))) FROM m{i - 1} a FULL JOIN m{i - 2} b ON a.col = b.col AND a."row" = b."row")
    / (SELECT max(greatest(col, "row")) + 1 FROM m0) >= {limit}"""
        go.append(f"""l{i} AS MATERIALIZED {live}, e{i} AS MATERIALIZED (SELECT a.col, m."row", sum(m.val * a.val) AS val FROM l{i} m JOIN {'m0' if regular else f'l{i}'} a ON m.col = a."row" GROUP BY 1, 2),
  k{i} AS (SELECT col, "row", val, count(*) OVER (PARTITION BY col) AS n0 FROM e{i}),
  s{i} AS (SELECT * FROM k{i} WHERE n0 = 1 OR round(val, 12) >= 0.0001 QUALIFY row_number() OVER (PARTITION BY col ORDER BY round(val, 12) DESC, "row") <= 50),
  m{i} AS MATERIALIZED (SELECT col, "row", pow(val, 2) / sum(pow(val, 2)) OVER (PARTITION BY col) AS val FROM s{i} UNION ALL SELECT * FROM {before} WHERE NOT (SELECT go FROM go{i - 1})),
  go{i} AS MATERIALIZED (SELECT coalesce(max(x), 0) >= {limit} AND {more} AS go FROM (SELECT CASE WHEN count(*) > 1 THEN (max(val) - sum(val * val)) * count(*) ELSE 0 END AS x FROM m{i} GROUP BY col))""")
    return ",\n  ".join(go)


#: Steps that the SQL of the converged flows unrolls; 8 to 16 are needed on the two smallest scales.
MOST_STEPS = 24


@_query(f"WITH RECURSIVE {SIM}, {_prepared('sim')}, {_until(MOST_STEPS)}, {_clusters(f'm{MOST_STEPS}')} SELECT node, cluster FROM clus")
def mcl_converged(spark, sf_dir):
    """Clusters of the part raster's limit."""
    m = matrix.build(_raster_graph(spark, sf_dir), "insert")
    return cl.clusters(algorithms.mcl(m, Params(), n=0)[0])


@_query(f"WITH RECURSIVE {SUPPLIERS}, {_prepared('sup')}, {_until(MOST_STEPS, regular=True)}, {_clusters(f'm{MOST_STEPS}')} SELECT node, cluster FROM clus")
def rmcl_converged(spark, sf_dir):
    """Clusters of the supplier graph's regularised flow."""
    m = matrix.build(tables.supplier_topk(spark, sf_dir), "insert")
    return cl.clusters(algorithms.rmcl(m, Params(max_iter=60))[0])


def _counted(i: int) -> str:
    """The counters of step i of ``_steps`` as rows."""
    columns = f"(SELECT count(*) AS k, max(val) AS most, CASE WHEN count(*) > 1 THEN (max(val) - sum(val * val)) * count(*) ELSE 0 END AS chaos FROM m{i} GROUP BY col)"
    kept = f"(SELECT col FROM k{i} WHERE n0 = 1 OR round(val, 12) >= 0.0001)"
    values = {
        "kmax": f"(SELECT max(k) FROM {columns})",
        "in_nnz": f"(SELECT count(*) FROM m{i - 1})",
        "products": f'(SELECT count(*) FROM m{i - 1} m JOIN m{i - 1} a ON m.col = a."row")',
        "out_nnz": f"(SELECT count(*) FROM m{i})",
        "cutoff": f"(SELECT count(*) FROM e{i}) - (SELECT count(*) FROM {kept})",
        "prune": f"(SELECT count(*) FROM {kept}) - (SELECT count(*) FROM s{i})",
        "attractors": f"(SELECT count(*) FILTER (most > 0.5) FROM {columns})",
        "homogen": f"(SELECT count(*) FILTER (chaos < 1e-4) FROM {columns}) + (SELECT count(DISTINCT col) FROM e{i} WHERE col NOT IN {kept})",
    }
    return " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS iteration, 'step' AS job, 'matrix' AS \"group\", '{k}' AS counter, CAST({v} AS BIGINT) AS value" for k, v in values.items())


@_query(f"WITH {FLOW}, {_prepared('flow')}, {_steps(['m0', 'm1', 'm2', 'm3'])} {' UNION ALL '.join(_counted(i) for i in range(1, 5))}")
def counters(spark, sf_dir):
    """Counters of four iterations on the nations."""
    return abc.counters(spark, algorithms.mcl(_stochastic_flow(spark, sf_dir), Params(force_iter=4), n=0)[1])


# Clusters

@_query(f"WITH {K3}, {_clusters('m3').split(',' + chr(10))[0]} SELECT col, attractor, strong FROM att")
def attractors(spark, sf_dir):
    return cl.attractors(raster_k3(spark, sf_dir))


@_query(f"WITH RECURSIVE {K3}, {_clusters('m3')} SELECT node, cluster FROM clus")
def clusters(spark, sf_dir):
    return cl.clusters(raster_k3(spark, sf_dir))


@_query(f"WITH {SEGMENTS} SELECT cluster, count(*) AS size FROM clus GROUP BY cluster")
def cluster_sizes(spark, sf_dir):
    return cl.sizes(_segments(spark, sf_dir))


@_query(f"WITH {SEGMENTS} SELECT count(*) AS nodes, count(DISTINCT cluster) AS clusters, round(count(*) / count(DISTINCT cluster), 6) AS avg_size FROM clus")
def average_size(spark, sf_dir):
    return cl.average_size(_segments(spark, sf_dir)).withColumn("avg_size", F.round("avg_size", 6))


@_query(f"""WITH {SEGMENTS}, twice AS (SELECT node, cluster FROM clus UNION ALL SELECT node, cluster FROM clus WHERE node = 1)
  SELECT cluster, count(*) AS size, (SELECT count(DISTINCT node) FROM twice) - count(DISTINCT node) AS rest, count(*) = count(DISTINCT node) AS consistent FROM twice GROUP BY cluster""")
def cluster_consistency(spark, sf_dir):
    """The cluster that lists node 1 a second time is not consistent."""
    c = _segments(spark, sf_dir)
    return cl.consistency(c.unionByName(c.where("node = 1")))


@_query(f"WITH {SEGMENTS} SELECT p_partkey AS node, cluster FROM part LEFT JOIN clus ON node = p_partkey")
def cluster_of(spark, sf_dir):
    return cl.cluster_of(_segments(spark, sf_dir), tables.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("node")))


@_query(f"WITH {SEGMENTS} SELECT node FROM clus WHERE cluster <> 2")
def complement(spark, sf_dir):
    return cl.complement(_segments(spark, sf_dir), 2)


@_query(f"WITH {SEGMENTS} SELECT node FROM clus WHERE cluster <> 2")
def complement_of(spark, sf_dir):
    c = _segments(spark, sf_dir)
    return cl.complement_of(c, cl.members(c, 2))


@_query(f"WITH {SEGMENTS} SELECT CAST(node // h AS INTEGER) AS x, CAST(node % h AS INTEGER) AS y, cluster FROM clus, dims")
def clusters_as_points(spark, sf_dir):
    return cl.as_points(_segments(spark, sf_dir), tables.raster_size(spark, sf_dir)[1])


# Cuts

_LABELLED = f"""{SIM}, clus AS (SELECT p_partkey AS node, CAST(p_size // 10 AS BIGINT) AS cluster FROM part, dims WHERE p_partkey < w * h),
  lab AS (SELECT sim.*, a.cluster AS a, b.cluster AS b FROM sim JOIN clus a ON a.node = sim."row" JOIN clus b ON b.node = sim.col)"""
_SHARES = "ns AS (SELECT a AS cluster, coalesce(sum(val) FILTER (a = b), 0) AS inside, sum(val) AS total FROM lab GROUP BY a)"


@_query(f"WITH {_LABELLED} SELECT a, b, round(sum(val), 6) AS cut FROM lab GROUP BY a, b")
def cut_pairs(spark, sf_dir):
    return quality.cut_pairs(_raster_graph(spark, sf_dir), _segments(spark, sf_dir)).select("a", "b", F.round("cut", 6).alias("cut"))


@_query(f"""WITH {_LABELLED} SELECT "row" AS node, round(sum(val), 6) AS total, round(coalesce(sum(val) FILTER (a = b), 0), 6) AS inside FROM lab GROUP BY 1""")
def cut_nodes(spark, sf_dir):
    return quality.cut_nodes(_raster_graph(spark, sf_dir), _segments(spark, sf_dir)).select("node", F.round("total", 6).alias("total"), F.round("inside", 6).alias("inside"))


@_query(f"WITH {_LABELLED}, {_SHARES} SELECT cluster, round(inside, 6) AS inside, round(total, 6) AS total, round(CASE WHEN total <> 0 THEN inside / total ELSE 0 END, 6) AS nassoc FROM ns")
def nassoc(spark, sf_dir):
    return quality.nassoc(_raster_graph(spark, sf_dir), _segments(spark, sf_dir)).select("cluster", *(F.round(c, 6).alias(c) for c in ("inside", "total", "nassoc")))


@_query(f"WITH {_LABELLED}, {_SHARES} SELECT count(*) AS clusters, round(count(*) - sum(inside / total), 6) AS ncut, round((count(*) - sum(inside / total)) / count(*), 6) AS avg FROM ns")
def ncut(spark, sf_dir):
    return quality.ncut(_raster_graph(spark, sf_dir), _segments(spark, sf_dir)).select("clusters", F.round("ncut", 6).alias("ncut"), F.round("avg", 6).alias("avg"))


@_query(f"WITH {_LABELLED}, {_SHARES} SELECT cluster, round(1 - inside / total, 6) AS ncut FROM ns")
def ncut_one(spark, sf_dir):
    return quality.ncut_one(_raster_graph(spark, sf_dir), _segments(spark, sf_dir)).select("cluster", F.round("ncut", 6).alias("ncut"))


@_query(f"""WITH {SIM}, many AS (SELECT 0 AS clustering, p_partkey AS node, CAST(p_size // 10 AS BIGINT) AS cluster FROM part, dims WHERE p_partkey < w * h
    UNION ALL SELECT 1, p_partkey, CAST(p_size % 7 AS BIGINT) FROM part, dims WHERE p_partkey < w * h UNION ALL SELECT 2, p_partkey, 0 FROM part, dims WHERE p_partkey < w * h),
  ns AS (SELECT a.clustering, a.cluster, coalesce(sum(val) FILTER (a.cluster = b.cluster), 0) AS inside, sum(val) AS total FROM sim JOIN many a ON a.node = sim."row" JOIN many b ON b.node = sim.col AND a.clustering = b.clustering GROUP BY 1, 2)
  SELECT clustering, count(*) AS clusters, round(count(*) - sum(inside / total), 6) AS ncut, round((count(*) - sum(inside / total)) / count(*), 6) AS avg FROM ns GROUP BY clustering""")
def ncut_many(spark, sf_dir):
    w, h = tables.raster_size(spark, sf_dir)
    parts = tables.load(spark, sf_dir, "part").where(F.col("p_partkey") < w * h)
    rules = (F.floor(F.col("p_size") / 10), F.col("p_size") % 7, F.lit(0))
    every = F.array(*(F.struct(F.lit(i).alias("clustering"), r.cast("long").alias("cluster")) for i, r in enumerate(rules)))
    many = parts.select(F.col("p_partkey").alias("node"), F.explode(every).alias("k")).select("k.clustering", "node", "k.cluster")
    return quality.ncut_many(_raster_graph(spark, sf_dir), many).select("clustering", "clusters", F.round("ncut", 6).alias("ncut"), F.round("avg", 6).alias("avg"))


@_query(f"""WITH {SEGMENTS}, col AS (SELECT cluster, c0, c1, c2, count(*) AS n FROM pix JOIN clus USING (node) GROUP BY ALL),
  ns AS (SELECT p.cluster, sum(p.n * q.n * exp(-({' + '.join(_sq('p.' + c, 'q.' + c) for c in BANDS)}))) AS total, sum(p.n * q.n * exp(-({' + '.join(_sq('p.' + c, 'q.' + c) for c in BANDS)}))) FILTER (p.cluster = q.cluster) AS inside FROM col p, col q GROUP BY 1)
  SELECT count(*) AS clusters, round(count(*) - sum(inside / total), 6) AS ncut FROM ns""")
def dense_ncut(spark, sf_dir):
    pixels, _, h = _raster(spark, sf_dir)
    return quality.dense_ncut(pixels.withColumn("node", (F.col("y") + F.col("x").cast("long") * h)), _segments(spark, sf_dir)).select("clusters", F.round("ncut", 6).alias("ncut"))


# Images

@_query(f"WITH {OFFSETS} SELECT dx, dy FROM offs")
def neighbourhood(spark, sf_dir):
    return similarity.offsets(spark, 3.0).select(F.col("dx").cast("long").alias("dx"), F.col("dy").cast("long").alias("dy"))


@_query(f"WITH {PIX}, {OFFSETS} SELECT p.node, count(*) AS near FROM pix p, offs, pix q WHERE q.x = p.x + dx AND q.y = p.y + dy GROUP BY 1")
def neighbours(spark, sf_dir):
    pixels, _, h = _raster(spark, sf_dir)
    return similarity.neighbours(pixels, RADIUS).groupBy((F.col("y") + F.col("x").cast("long") * h).alias("node")).agg(F.count("*").alias("near"))


@_query(f"WITH {SIM} {OUT} sim")
def image_similarity(spark, sf_dir):
    return _entries(_raster_graph(spark, sf_dir))


@_query(f"WITH {_sim('p.x + p.w * p.y', 'q.x + q.w * q.y', '(sqrt(-9 / ln(0.5)) * sqrt(-9 / ln(0.5)))')} {OUT} sim")
def image_similarity_old(spark, sf_dir):
    pixels, w, h = _raster(spark, sf_dir)
    return _entries(similarity.image_similarity_old(pixels, w, h, RADIUS, SIGMA_F, BANDS))


_FRAME = f"{DIMS}, fr AS (SELECT p_partkey AS node, p_partkey // h AS x, p_partkey % h AS y, CAST(p_partkey // h AS DOUBLE) AS fx, CAST(p_partkey % h AS DOUBLE) AS fy, p_size / 10.0 AS fz, p_retailprice * 50.0 AS fi FROM part, dims WHERE p_partkey < w * h)"


@_query(f"""WITH {_FRAME}, {OFFSETS}, sim AS (SELECT p.node AS col, q.node AS "row", round(exp(-(({_sq('p.fx', 'q.fx')} + {_sq('p.fy', 'q.fy')} + {_sq('p.fz', 'q.fz')}) / CAST(8 AS DOUBLE)) - {_sq('p.fi', 'q.fi')} / CAST(65535.0 * 65535.0 * 0.0005 AS DOUBLE)), 6) AS val
  FROM fr p, offs, fr q WHERE q.x = p.x + dx AND q.y = p.y + dy) {OUT} sim""")
def tof_similarity(spark, sf_dir):
    w, h = tables.raster_size(spark, sf_dir)
    return _entries(similarity.tof_similarity(tables.part_frame(spark, sf_dir, w, h), w, h, RADIUS, 8.0, 0.0005))


@_query(f"WITH {_FRAME} SELECT node, CAST(floor(least(greatest((fi - 45200.0) / 4500.0, 0), 1) * 255) AS INTEGER) AS grey FROM fr")
def greyscale(spark, sf_dir):
    w, h = tables.raster_size(spark, sf_dir)
    return colour.greyscale(tables.part_frame(spark, sf_dir, w, h), "I", 45200.0, 49700.0)


def _lab_sql() -> str:
    c = lambda v: f"CASE WHEN {v} <= 0.04045 THEN {v} / 12.92 ELSE pow(({v} + 0.055) / 1.055, 2.4) END"
    xyz = [" + ".join(f"lin{b} * {k!r}" for b, k in zip("rgb", row, strict=True)) for row in colour.TO_XYZ]
    f = lambda v: f"CASE WHEN {v} > pow(6.0 / 29.0, 3) THEN cbrt({v}) ELSE {v} / (3 * (6.0 / 29.0) * (6.0 / 29.0)) + 4.0 / 29.0 END"
    return f"""src AS (SELECT p_partkey AS node, (p_size * 5) / 255.0 AS r, (p_partkey % 256) / 255.0 AS g, ((p_retailprice - 900) * 2) / 255.0 AS b FROM part),
  lin AS (SELECT node, {c('r')} AS linr, {c('g')} AS ling, {c('b')} AS linb FROM src), xyz AS (SELECT node, {xyz[0]} AS X, {xyz[1]} AS Y, {xyz[2]} AS Z FROM lin),
  fs AS (SELECT node, {f('X')} AS fx, {f('Y')} AS fy, {f('Z')} AS fz FROM xyz), lab AS (SELECT node, 116 * fy - 16 AS l, 500 * (fx - fy) AS a, 200 * (fy - fz) AS bb FROM fs)"""


def _coloured(spark, sf_dir):
    parts = tables.load(spark, sf_dir, "part")
    return parts.select(F.col("p_partkey").alias("node"), (F.col("p_size") * 5).cast("double").alias("c0"), (F.col("p_partkey") % 256).cast("double").alias("c1"), ((F.col("p_retailprice") - 900) * 2).alias("c2"))


@_query(f"WITH {_lab_sql()} SELECT node, round(l, 4) AS l, round(a, 4) AS a, round(bb, 4) AS b FROM lab")
def lab(spark, sf_dir):
    out = colour.rgb_to_lab(_coloured(spark, sf_dir), eight_bit=False)
    return out.select("node", *(F.round(c, 4).alias(n) for c, n in zip(BANDS, ("l", "a", "b"), strict=True)))


@_query(f"WITH {_lab_sql()} SELECT node, CAST(floor(least(greatest(l / 128, 0), 1) * 255 + 0.5) AS INTEGER) AS l, CAST(floor(least(greatest((a + 128) / 256, 0), 1) * 255 + 0.5) AS INTEGER) AS a, CAST(floor(least(greatest((bb + 128) / 256, 0), 1) * 255 + 0.5) AS INTEGER) AS b FROM lab")
def lab_bytes(spark, sf_dir):
    out = colour.rgb_to_lab(_coloured(spark, sf_dir))
    return out.select("node", *(F.col(c).cast("int").alias(n) for c, n in zip(BANDS, ("l", "a", "b"), strict=True)))


@_query("SELECT p_partkey AS node, CAST(p_size * 5 AS DOUBLE) AS r, CAST(p_partkey % 256 AS DOUBLE) AS g, round((p_retailprice - 900) * 2, 1) AS b FROM part")
def lab_round_trip(spark, sf_dir):
    """Colours there and back again."""
    back = colour.lab_to_rgb(colour.rgb_to_lab(_coloured(spark, sf_dir), eight_bit=False))
    return back.select("node", *(F.abs(F.round(c, 1)).alias(n) for c, n in zip(BANDS, ("r", "g", "b"), strict=True)))


@_query(f"WITH {PIX} SELECT {', '.join(f'{f}({c}) AS {f}_{c}' for c in BANDS for f in ('min', 'max'))} FROM pix")
def channel_range(spark, sf_dir):
    return colour.channel_range(_raster(spark, sf_dir)[0])


_AROUND = f"""{SEGMENTS}, pl AS (SELECT CAST(node // h AS INTEGER) AS x, CAST(node % h AS INTEGER) AS y, cluster FROM clus, dims),
  ar AS (SELECT p.x, p.y, p.cluster, e.cluster AS s0, w.cluster AS s1, n.cluster AS s2, s.cluster AS s3 FROM pl p LEFT JOIN pl e ON e.x = p.x + 1 AND e.y = p.y LEFT JOIN pl w ON w.x = p.x - 1 AND w.y = p.y
    LEFT JOIN pl n ON n.x = p.x AND n.y = p.y + 1 LEFT JOIN pl s ON s.x = p.x AND s.y = p.y - 1),
  bo AS (SELECT *, coalesce({', '.join(f'CASE WHEN s{k} <> cluster THEN s{k} END' for k in range(4))}) AS neighbour FROM ar)"""


@_query(f"WITH {_AROUND} SELECT 0 AS frame, x, y, cluster, neighbour IS NOT NULL AS is_boundary, neighbour FROM bo")
def boundary(spark, sf_dir):
    return render.boundary(_segments(spark, sf_dir), *tables.raster_size(spark, sf_dir))


_MEANS = f"""{_AROUND}, px AS (SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, c0, c1, c2, cluster FROM pix JOIN clus USING (node)),
  me AS (SELECT cluster, count(*) AS size, avg(c0) AS m0, avg(c1) AS m1, avg(c2) AS m2 FROM px GROUP BY cluster)"""


@_query(f"""WITH {_MEANS}, sp AS (SELECT cluster, sum(sqrt({' + '.join(_sq(f'c{k}', f'm{k}') for k in range(3))})) AS spread FROM px JOIN me USING (cluster) GROUP BY cluster)
  SELECT cluster, size, round(m0, 6) AS m0, round(m1, 6) AS m1, round(m2, 6) AS m2, round(spread, 6) AS spread FROM me JOIN sp USING (cluster)""")
def mean_colour(spark, sf_dir):
    pixels, w, h = _raster(spark, sf_dir)
    return render.cluster_colours(pixels, _segments(spark, sf_dir), w, h).select("cluster", "size", *(F.round(c, 6).alias(c) for c in ("m0", "m1", "m2", "spread")))


_BYTES = ("least(greatest(l / 128, 0), 1)", "least(greatest((a + 128) / 256, 0), 1)", "least(greatest((bb + 128) / 256, 0), 1)")
_LAB_MEANS = f"""{_AROUND}, {_lab_sql()}, me AS (SELECT cluster, {', '.join(f'avg(floor({v} * 255 + 0.5)) AS m{k}' for k, v in enumerate(_BYTES))} FROM lab JOIN clus USING (node) GROUP BY cluster)"""


@_query(f"""WITH {_LAB_MEANS} SELECT x, y, round(CASE WHEN neighbour IS NULL THEN 0 ELSE least(10 * sqrt({' + '.join(_sq(f'a.m{k}', f'b.m{k}') for k in range(3))}), 255) END, 6) AS contrast
  FROM bo JOIN me a ON a.cluster = bo.cluster LEFT JOIN me b ON b.cluster = bo.neighbour""")
def contrast(spark, sf_dir):
    """Contrast in Lab; of the parts' colours, as prices are no bytes."""
    w, h = tables.raster_size(spark, sf_dir)
    at = [F.floor(F.col("node") / h).cast("int").alias("x"), (F.col("node") % h).cast("int").alias("y")]
    pixels = _coloured(spark, sf_dir).where(F.col("node") < w * h).select(*at, *BANDS)
    return render.contrast(pixels, _segments(spark, sf_dir), w, h).select("x", "y", F.round("contrast", 6).alias("contrast"))


@_query(f"WITH {_MEANS} SELECT 0 AS frame, x, y, {', '.join(f'CASE WHEN neighbour IS NULL THEN px.c{k} ELSE 255.0 END AS c{k}' for k in range(3))} FROM bo JOIN px USING (x, y)")
def outline(spark, sf_dir):
    pixels, w, h = _raster(spark, sf_dir)
    return render.outline(pixels, _segments(spark, sf_dir), w, h)


@_query(f"""WITH {_MEANS}, q AS (SELECT 2 * x + i.range AS x2, 2 * y + j.range AS y2, px.c0, px.c1, px.c2, coalesce(CASE WHEN i.range = 1 THEN s0 ELSE s1 END <> bo.cluster, false) OR coalesce(CASE WHEN j.range = 1 THEN s2 ELSE s3 END <> bo.cluster, false) AS l
  FROM bo JOIN px USING (x, y), range(0, 2) i, range(0, 2) j) SELECT 0 AS frame, CAST(x2 AS INTEGER) AS x, CAST(y2 AS INTEGER) AS y, {', '.join(f'CASE WHEN l THEN 127.5 ELSE c{k} END AS c{k}' for k in range(3))} FROM q""")
def outline_hq(spark, sf_dir):
    pixels, w, h = _raster(spark, sf_dir)
    return render.outline(pixels, _segments(spark, sf_dir), w, h, line=0.5, hq=True)


@_query(f"WITH {SEGMENTS} SELECT CAST(node // h AS INTEGER) AS x, CAST(node % h AS INTEGER) AS y, CAST(((cluster * 2654435761 + 3 * 40503) % 4294967296) % 256 AS INTEGER) AS grey FROM clus, dims")
def flat_colours(spark, sf_dir):
    return render.flat_colours(_segments(spark, sf_dir), *tables.raster_size(spark, sf_dir), seed=3)


@_query(f"""WITH d AS (SELECT a.vec_id AS col, b.vec_id AS "row", round(exp(-list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(z[1] - z[2] AS DOUBLE) * CAST(z[1] - z[2] AS DOUBLE))) / CAST(0.5 AS DOUBLE)), 6) AS val FROM embeddings a, embeddings b),
  k AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY val DESC, "row") AS n FROM d), s AS (SELECT col, "row", val FROM k WHERE n <= 6 OR col = "row"),
  g AS (SELECT * FROM s UNION SELECT "row", col, val FROM s) {OUT} g""")
def embedding_graph(spark, sf_dir):
    return _entries(similarity.knn_graph(tables.load(spark, sf_dir, "embeddings"), 6, 0.5))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the part raster after three iterations."""
    return cl.clusters(raster_k3(spark, sf_dir))
