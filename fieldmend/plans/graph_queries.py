"""Queries of neighbours, graph refiners, tiles, evaluation and masks, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmend.functions.rng import pick, uniform
from fieldmend.operators import graph, masks, metrics, tiles
from fieldmend.operators.knn import nearest, nearest_lists, undirected
from fieldmend.plans import fields
from fieldmend.plans.registry import query, rounded, table
from fieldmend.plans.repair_queries import FINAL, chain
from fieldmend.session import few, scratch
from fieldmend.streaming import evaluation

K, DIMS = 11, 3
U = "(CAST('0x' || substr(md5(concat_ws(':', '{seed}', '{stream}', CAST({id} AS VARCHAR))), 1, 13) AS BIGINT) / 4503599627370496.0)"


def u_sql(seed: int, stream: str, id_: str) -> str:
    """The same draw as functions.rng.uniform."""
    return U.format(seed=seed, stream=stream, id=id_)


def edges_sql(points: str, dims: int, k: int) -> str:
    d2 = " + ".join(f"(a.{x} - b.{x}) * (a.{x} - b.{x})" for x in "xyz"[:dims])
    return f"""pts AS ({points}), e AS (SELECT * FROM (SELECT sample, src, dst, d2, row_number() OVER (PARTITION BY sample, src ORDER BY d2, dst) AS rank
  FROM (SELECT a.sample, a.id AS src, b.id AS dst, {d2} AS d2 FROM pts a JOIN pts b ON a.sample = b.sample AND a.id <> b.id)) WHERE rank <= {k})"""


EMB_E = edges_sql(fields.EMB, DIMS, K)


def emb(spark, d):
    p = fields.embeddings(spark, d)
    return p, nearest(p, DIMS, K)


def _edges(name: str, points: str, source, dims: int, k: int):
    @query(name, f"WITH {edges_sql(points, dims, k)} SELECT sample, src, dst, round(d2, 6) AS d2, CAST(rank AS INTEGER) AS rank FROM e")
    def run(spark, d):
        return rounded(nearest(source(spark, d), dims, k), "d2").select("sample", "src", "dst", "d2", "rank")


_edges("q_knn_edges", fields.EMB, fields.embeddings, 3, 8)
_edges("q_knn_edges_grid", fields.CUST, fields.customers, 2, 16)
_edges("q_knn_edges_ties", fields.PART, fields.parts, 2, 12)


@query("q_knn_undirected", f"WITH {EMB_E} SELECT DISTINCT sample, least(src, dst) AS a, greatest(src, dst) AS b FROM e")
def q_knn_undirected(spark, d):
    return undirected(emb(spark, d)[1])


MODAL = """v AS (SELECT e.sample, src, p.code AS vote, count(*) AS n, min(rank) AS first FROM e JOIN pts p ON p.sample = e.sample AND p.id = e.dst GROUP BY ALL),
best AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY sample, src ORDER BY n DESC, first) = 1)
SELECT p.sample, p.id, p.code, CAST(b.vote AS INTEGER) AS refined FROM pts p JOIN best b ON b.sample = p.sample AND b.src = p.id"""


def _modal(name: str, points: str, source, dims: int, k: int):
    @query(name, f"WITH {edges_sql(points, dims, k)}, {MODAL}")
    def run(spark, d):
        return graph.modal_labels(nearest_lists(source(spark, d), dims, k, carry="code", lists=("vote",)))


_modal("q_modal_knn", fields.CUST, fields.customers, 2, 50)
_modal("q_modal_orders", fields.ORD, fields.orders, 2, 50)
_modal("q_modal_filter", fields.EMB, fields.embeddings, 3, 8)


def majority_sql(points: str) -> str:
    return f"""WITH {edges_sql(points, 2, 6)},
v AS (SELECT sample, src, vote, count(*) AS n FROM (SELECT e.sample, src, p.code AS vote FROM e JOIN pts p ON p.sample = e.sample AND p.id = e.dst UNION ALL SELECT sample, id, code FROM pts) GROUP BY ALL),
b AS (SELECT v.*, p.code, max(CASE WHEN vote = code THEN n END) OVER (PARTITION BY v.sample, src) AS mine FROM v JOIN pts p ON p.sample = v.sample AND p.id = v.src
  QUALIFY row_number() OVER (PARTITION BY v.sample, src ORDER BY n DESC, (vote <> code), vote) = 1)
SELECT sample, src AS id, code, CAST(CASE WHEN mine < 3.0 AND n > 3.0 THEN vote ELSE code END AS INTEGER) AS refined FROM b"""


def majority6(points):
    return graph.strict_majority_labels(nearest_lists(points, 2, 6, carry="code", lists=("vote",)))


def _majority(name: str, points: str, source):
    @query(name, majority_sql(points))
    def run(spark, d):
        return majority6(source(spark, d))


_majority("q_majority_strict", fields.CUST, fields.customers)
_majority("q_majority_orders", fields.ORD, fields.orders)


def automatic_edges_sql(points: str, dims: int, classes: int) -> str:
    """edges_sql with each specimen's automatic number of neighbours."""
    k = f"least(31, greatest(11, floor(1.6 * log2(count(*)) * {min(1.0, 5 / classes)} + 0.5)))"
    pts, e = edges_sql(points, dims, 31).split(", e AS (", 1)
    return f"{pts}, e31 AS ({e}, e AS (SELECT e31.* FROM e31 JOIN (SELECT sample, {k} AS k FROM pts GROUP BY sample) s ON s.sample = e31.sample AND rank <= s.k)"


def sweeps_sql(settings: graph.VoteSettings, classes: int, edges: str = EMB_E) -> str:
    s = settings.checked(classes)
    w = "exp(-d2 / greatest(max(d2) OVER (PARTITION BY sample, src), 1e-12))" if s.weighted else "1.0::DOUBLE"
    sql = f"WITH {edges}, w AS (SELECT sample, src, dst, {w} AS w FROM e), s0 AS (SELECT sample, id, code, code AS cur, 1.0::DOUBLE AS confidence FROM pts)"
    for k in range(s.iterations):
        sql += f""", v{k} AS (SELECT w.sample, w.src, b.cur AS cls, sum(w) AS raw FROM w JOIN s{k} b ON b.sample = w.sample AND b.id = w.dst GROUP BY ALL),
t{k} AS (SELECT sample, src, sum(raw) AS tw FROM v{k} GROUP BY ALL),
a{k} AS (SELECT a.sample, a.id, a.code, a.cur, tw, coalesce(h.raw, 0.0) AS held FROM s{k} a JOIN t{k} t ON t.sample = a.sample AND t.src = a.id LEFT JOIN v{k} h ON h.sample = a.sample AND h.src = a.id AND h.cls = a.cur),
c{k} AS (SELECT sample, id, cur AS cls, held + {s.preserve} * tw AS v FROM a{k} UNION ALL SELECT v.sample, v.src, v.cls, v.raw FROM v{k} v JOIN s{k} a ON a.sample = v.sample AND a.id = v.src WHERE v.cls <> a.cur),
r{k} AS (SELECT c.*, row_number() OVER (PARTITION BY c.sample, c.id ORDER BY v DESC, (cls <> a.cur), cls) AS rk FROM c{k} c JOIN s{k} a ON a.sample = c.sample AND a.id = c.id),
s{k + 1} AS (SELECT a.sample, a.id, a.code, CASE WHEN b.cls <> a.cur AND a.held / a.tw <= {s.current_support} AND b.v / (a.tw * {1 + s.preserve}) >= {s.consensus}
    AND (b.v - coalesce(n.v, 0.0)) / (a.tw * {1 + s.preserve}) >= {s.margin} THEN b.cls ELSE a.cur END AS cur, b.v / (a.tw * {1 + s.preserve}) AS confidence
  FROM a{k} a JOIN r{k} b ON b.sample = a.sample AND b.id = a.id AND b.rk = 1 LEFT JOIN r{k} n ON n.sample = a.sample AND n.id = a.id AND n.rk = 2)"""
    return sql + f" SELECT sample, id, code, CAST(cur AS INTEGER) AS refined, round(confidence, 6) AS confidence FROM s{s.iterations}"


#: The embeddings' labels are noisy, so a high tolerated support lets labels move.
LOOSE = graph.VoteSettings(3, 0.5, 0.0, 0.0, True, 1.0)


def _vote(name: str, settings: graph.VoteSettings):
    @query(name, sweeps_sql(settings, fields.EMB_CLASSES))
    def run(spark, d):
        done, _ = graph.refine(fields.embeddings(spark, d), DIMS, fields.EMB_CLASSES, settings, K)
        return rounded(done, "confidence").select("sample", "id", "code", "refined", "confidence")


_vote("q_vote_1sweep", graph.KNN_VOTE)
_vote("q_vote_icm8", graph.POTTS_LIKE)
_vote("q_vote_weighted3", graph.VoteSettings())
_vote("q_vote_loose", LOOSE)


@query("q_vote_automatic", sweeps_sql(graph.VoteSettings(), fields.EMB_CLASSES, automatic_edges_sql(fields.EMB, DIMS, fields.EMB_CLASSES)))
def q_vote_automatic(spark, d):
    """The iterated vote with its defaults, the number of neighbours among them."""
    done, _ = graph.refine(fields.embeddings(spark, d), DIMS, fields.EMB_CLASSES)
    return rounded(done, "confidence").select("sample", "id", "code", "refined", "confidence")


def _vote_orders(name: str, settings: graph.VoteSettings):
    @query(name, sweeps_sql(settings, 3, edges_sql(fields.ORD, 2, K)))
    def run(spark, d):
        done, _ = graph.refine(fields.orders(spark, d), 2, 3, settings, K)
        return rounded(done, "confidence").select("sample", "id", "code", "refined", "confidence")


_vote_orders("q_vote_orders", LOOSE)
_vote_orders("q_vote_potts_orders", graph.VoteSettings(8, 0.5, 0.35, 0.0, False, 1.0))


@query("q_modal_automatic", f"WITH {automatic_edges_sql(fields.CUST, 2, 5)}, {MODAL}")
def q_modal_automatic(spark, d):
    """The modal label of each specimen's automatic number of neighbours."""
    return graph.modal_labels(nearest_lists(fields.customers(spark, d), 2, None, carry="code", lists=("vote",), classes=5))


_SWEEPS = " UNION ALL ".join(f"SELECT {k + 1} AS sweep, count(*) AS changes FROM s{k} a JOIN s{k + 1} b ON a.sample = b.sample AND a.id = b.id AND a.cur <> b.cur" for k in range(LOOSE.iterations))


@query("q_vote_changes", sweeps_sql(LOOSE, fields.EMB_CLASSES).rsplit(" SELECT sample, id, code", 1)[0] + f" SELECT CAST(sweep AS INTEGER) AS sweep, changes FROM ({_SWEEPS}) QUALIFY coalesce(min(changes) OVER (ORDER BY sweep ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) > 0")
def q_vote_changes(spark, d):
    """How many labels each sweep of the iterated vote changes."""
    _, changes = graph.refine(fields.embeddings(spark, d), DIMS, fields.EMB_CLASSES, LOOSE, K)
    return spark.createDataFrame(list(enumerate(changes, 1)), "sweep int, changes long")


MODAL_ROWS = MODAL.replace("\nSELECT", ", m AS (SELECT", 1) + ")"


@query(
    "q_potts_energy",
    f"""WITH {EMB_E}, {MODAL_ROWS},
pair AS (SELECT DISTINCT sample, least(src, dst) AS a, greatest(src, dst) AS b FROM e),
cut AS (SELECT pair.sample, count(*) FILTER (x.refined <> y.refined) AS cuts FROM pair JOIN m x ON x.sample = pair.sample AND x.id = pair.a JOIN m y ON y.sample = pair.sample AND y.id = pair.b GROUP BY ALL),
mv AS (SELECT sample, count(*) FILTER (refined <> code) AS moved FROM m GROUP BY ALL)
SELECT sample, moved, cuts, CAST(5.0 * moved + cuts AS DOUBLE) AS energy FROM mv JOIN cut USING (sample)""",
)
def q_potts_energy(spark, d):
    p, e = emb(spark, d)
    return graph.potts_energy(graph.modal(p, e), undirected(e), "refined")


BOX = "box AS (SELECT sample, min(x) AS lx, min(y) AS ly, max(x) - min(x) AS sx, max(y) - min(y) AS sy FROM pts GROUP BY sample)"
TILES = f"""WITH pts AS ({fields.ORD}), {BOX},
t AS (SELECT sample, i, j, lx + i * (sx / 3) AS x0, lx + (i + 1) * (sx / 3) AS x1, ly + j * (sy / 2) AS y0, ly + (j + 1) * (sy / 2) AS y1, sx / 3 AS wx, sy / 2 AS wy FROM box, range(3) a(i), range(2) b(j)),
d AS (SELECT p.sample, CAST(1 + i + 3 * j AS INTEGER) AS tile, id,
  x >= x0 AND (i = 2 OR x < x1) AND y >= y0 AND (j = 1 OR y < y1) AS is_core,
  (i = 0 OR x >= x0 - 0.15 * wx) AND (i = 2 OR x <= x1 + 0.15 * wx) AND (j = 0 OR y >= y0 - 0.15 * wy) AND (j = 1 OR y <= y1 + 0.15 * wy) AS is_halo
  FROM pts p JOIN t USING (sample))"""


def _tiles(spark, d):
    p = fields.orders(spark, d)
    return tiles.tiles(p, tiles.layout(p, 2, counts=[3, 2]), 2)


@query("q_tiles_core", f"{TILES} SELECT sample, tile, id FROM d WHERE is_core")
def q_tiles_core(spark, d):
    return _tiles(spark, d).where("is_core").select("sample", "tile", "id")


@query("q_tiles_halo", f"{TILES} SELECT sample, tile, id, is_core FROM d WHERE is_halo")
def q_tiles_halo(spark, d):
    return _tiles(spark, d)


@query("q_tiles_summary", f"{TILES} SELECT sample, tile, count(*) FILTER (is_core) AS core_n, count(*) AS halo_n FROM d WHERE is_halo GROUP BY ALL")
def q_tiles_summary(spark, d):
    return tiles.tile_summary(_tiles(spark, d))


WITH_HALO = f"{TILES} SELECT * FROM d WHERE is_halo QUALIFY is_core OR (count(*) OVER (PARTITION BY sample, tile) >= 3 AND count(*) FILTER (is_core) OVER (PARTITION BY sample, tile) > 0)"
TILED = f"SELECT concat(t.sample, '#', t.tile) AS sample, t.id, o.x, o.y, o.code FROM ({WITH_HALO}) t JOIN ({fields.ORD}) o ON o.sample = t.sample AND o.id = t.id"


@query(
    "q_tiles_majority",
    f"""SELECT c.sample, c.tile, c.id, m.code, m.refined FROM ({TILES} SELECT sample, tile, id FROM d WHERE is_core) c
JOIN ({majority_sql(TILED)}) m ON m.sample = concat(c.sample, '#', c.tile) AND m.id = c.id""",
)
def q_tiles_majority(spark, d):
    """The strict majority of six neighbours, found in each tile and its halo alone."""
    return tiles.in_tiles(fields.orders(spark, d), 2, majority6, counts=[3, 2]).select("sample", "tile", "id", "code", "refined")


#: What suits a whole specimen, for the tiles it is cut into.
_K = "SELECT sample AS of, CAST(least(31, greatest(11, round_even(1.6 * log2(count(*)) * least(1.0, 5.0 / count(DISTINCT code)), 0))) AS INTEGER) AS k FROM ({points}) GROUP BY sample"


def tiled_edges_sql() -> str:
    pts, e = edges_sql(TILED, 2, 31).split(", e AS (", 1)
    return f"{pts}, e31 AS ({e}, ks AS ({_K.format(points=fields.ORD)}), e AS (SELECT e31.* FROM e31 JOIN ks ON ks.of = split_part(e31.sample, '#', 1) AND rank <= ks.k)"


TILED_VOTE = sweeps_sql(LOOSE, 3, tiled_edges_sql())


@query("q_tiles_vote", f"SELECT c.sample, c.tile, c.id, v.code, v.refined, v.confidence FROM ({TILES} SELECT sample, tile, id FROM d WHERE is_core) c JOIN ({TILED_VOTE}) v ON v.sample = concat(c.sample, '#', c.tile) AND v.id = c.id")
def q_tiles_vote(spark, d):
    """The iterated vote in each tile and its halo, as refined labels of the cores."""
    done, _ = tiles.vote_in_tiles(fields.orders(spark, d), 2, 3, LOOSE, counts=[3, 2])
    return rounded(done, "confidence").select("sample", "tile", "id", "code", "refined", "confidence")


@query(
    "q_tiles_diagnostics",
    f"""SELECT h.sample, h.tile, core_n, halo_n, CAST(least(k, halo_n - 1) AS INTEGER) AS neighbors, final_changes
FROM (SELECT sample, tile, count(*) FILTER (is_core) AS core_n, count(*) AS halo_n FROM ({WITH_HALO}) GROUP BY ALL) h JOIN ({_K.format(points=fields.ORD)}) ON of = h.sample
JOIN (SELECT c.sample, c.tile, count(*) FILTER (v.refined <> v.code) AS final_changes FROM ({TILES} SELECT sample, tile, id FROM d WHERE is_core) c
  JOIN ({TILED_VOTE}) v ON v.sample = concat(c.sample, '#', c.tile) AND v.id = c.id GROUP BY ALL) f ON f.sample = h.sample AND f.tile = h.tile""",
)
def q_tiles_diagnostics(spark, d):
    """A row per tile of the iterated vote: its core, its halo, its number of neighbours and how many labels of the core changed."""
    return tiles.vote_in_tiles(fields.orders(spark, d), 2, 3, LOOSE, counts=[3, 2])[1]


# Evaluation: orders' status as truth, a hashed corruption as initial labels, half of it undone as refined ones.
TRIPLE = f"""SELECT sample, id, truth, CASE WHEN {u_sql(1, 'hit', 'id')} < 0.3 THEN other ELSE truth END AS initial,
CASE WHEN {u_sql(1, 'hit', 'id')} < 0.3 AND {u_sql(1, 'back', 'id')} < 0.6 THEN truth WHEN {u_sql(1, 'hit', 'id')} < 0.3 OR {u_sql(1, 'harm', 'id')} < 0.05 THEN other ELSE truth END AS refined,
y < 100000 AS boundary FROM (SELECT sample, id, y, {fields.ORD_LEVELS}[code] AS truth,
{fields.ORD_LEVELS}[(code - 1 + 1 + CAST(least(floor({u_sql(1, 'which', 'id')} * 2), 1) AS INTEGER)) % 3 + 1] AS other FROM ({fields.ORD}))"""


def triple(spark, d):
    levels = F.array(*map(F.lit, fields.ORD_LEVELS))
    p = fields.orders(spark, d)
    hit, back, harm = (uniform(1, s, "id") for s in ("hit", "back", "harm"))
    truth, other = F.element_at(levels, F.col("code")), F.element_at(levels, (F.col("code") + pick(1, "which", 2, "id")) % 3 + 1)
    initial = F.when(hit < 0.3, F.col("other")).otherwise(F.col("truth"))
    refined = F.when((hit < 0.3) & (back < 0.6), F.col("truth")).when((hit < 0.3) | (harm < 0.05), F.col("other")).otherwise(F.col("truth"))
    return p.withColumns({"truth": truth, "other": other}).select("sample", "id", "truth", initial.alias("initial"), refined.alias("refined"), (F.col("y") < 100000).alias("boundary"))


def eval_sql(keys: list[str]) -> str:
    k, g = "".join(f"{c}, " for c in keys), "GROUP BY " + ", ".join(keys) if keys else ""
    on = f"USING ({', '.join(keys)})" if keys else "ON true"
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    r = lambda x, n: f"round({x}, 6) + 0.0 AS {n}"
    avg = lambda x, w="true": f"avg(({x})::INT) FILTER ({w})"
    ok, was = "refined = truth", "initial = truth"
    return f"""t AS ({TRIPLE}),
rg AS (SELECT {k}truth, count(*) AS c FROM t GROUP BY ALL),
lo AS (SELECT {k}truth AS lo FROM rg QUALIFY row_number() OVER ({part}ORDER BY c, truth) = 1),
hi AS (SELECT {k}truth AS hi FROM rg QUALIFY row_number() OVER ({part}ORDER BY c DESC, truth) = 1),
m AS (SELECT * FROM t JOIN lo {on} JOIN hi {on}),
one AS (SELECT {k}count(*) AS n, count(DISTINCT truth) AS classes, {avg(was)} AS ia, {avg(ok)} AS acc, {avg(ok, 'truth = lo')} AS sp, {avg(ok, 'truth = hi')} AS de, {avg(ok, 'boundary')} AS bo, {avg(ok, 'NOT boundary')} AS inn,
  {avg(ok, 'initial <> truth')} AS cr, {avg('refined <> truth', was)} AS dr, {avg(ok, 'refined <> initial')} AS cp, {avg('refined <> initial')} AS cf FROM m {g}),
rc AS (SELECT {k}avg(r) AS ma, min(r) AS wo FROM (SELECT {k}truth, {avg(ok)} AS r FROM t GROUP BY ALL) {g}),
ct AS (SELECT {k}truth, refined, count(*)::DOUBLE AS n FROM t GROUP BY ALL),
s1 AS (SELECT {k}sum(n * (n - 1) / 2) AS s, sum(n) AS tot FROM ct {g}),
s2 AS (SELECT {k}sum(n * (n - 1) / 2) AS sa FROM (SELECT {k}truth, sum(n) AS n FROM ct GROUP BY ALL) {g}),
s3 AS (SELECT {k}sum(n * (n - 1) / 2) AS sb FROM (SELECT {k}refined, sum(n) AS n FROM ct GROUP BY ALL) {g}),
ar AS (SELECT {k}(s - sa * sb / (tot * (tot - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (tot * (tot - 1) / 2)) AS ari FROM s1 JOIN s2 {on} JOIN s3 {on}),
res AS (SELECT {k}n, classes, {r('ia', 'initial_accuracy')}, {r('acc', 'accuracy')}, {r('acc - ia', 'accuracy_gain')}, {r('((1 - ia) - (1 - acc)) / (1 - ia)', 'error_reduction')}, {r('ari', 'ari')},
  {r('ma', 'macro_recall')}, {r('wo', 'worst_recall')}, {r('sp', 'sparse_region_accuracy')}, {r('de', 'dense_region_accuracy')}, {r('bo', 'boundary_accuracy')}, {r('inn', 'interior_accuracy')}, {r('cr', 'correction_recall')},
  {r('dr', 'damage_rate')}, {r('cp', 'changed_precision')}, {r('cf', 'changed_fraction')}, 0.0::DOUBLE AS unresolved_fraction, CAST(NULL AS DOUBLE) AS seconds
  FROM one JOIN rc {on} JOIN ar {on})"""


MEASURES = ["initial_accuracy", "accuracy", "accuracy_gain", "error_reduction", "ari", "macro_recall", "worst_recall", "sparse_region_accuracy", "dense_region_accuracy", "boundary_accuracy", "interior_accuracy", "correction_recall", "damage_rate", "changed_precision", "changed_fraction", "unresolved_fraction"]


@query("q_eval_overall", f"WITH {eval_sql([])} SELECT * FROM res")
def q_eval_overall(spark, d):
    return rounded(metrics.evaluate(triple(spark, d)), *MEASURES)


@query("q_eval_stream", f"WITH {eval_sql(['sample'])} SELECT * FROM res")
def q_eval_stream(spark, d):
    """The evaluation by specimen of orders that arrive in eight files, two a batch, by counts kept as the state of a stream."""
    place = scratch(spark, "arriving")
    rows = triple(spark, d)
    rows.repartition(8, "id").write.parquet(f"{place}/rows")
    stream = evaluation.arriving(spark, f"{place}/rows", rows.schema, 2)
    evaluation.evaluate_stream(stream, f"{place}/counts", f"{place}/checkpoint", ["sample"]).awaitTermination()
    return rounded(evaluation.evaluated(spark, f"{place}/counts", ["sample"]), *MEASURES)


@query("q_eval_strata", f"WITH {eval_sql(['sample'])} SELECT * FROM res")
def q_eval_strata(spark, d):
    return rounded(metrics.evaluate(triple(spark, d), ["sample"]), *MEASURES)


@query("q_eval_by_class", f"WITH t AS ({TRIPLE}) SELECT sample, truth, count(*) AS n, round(avg((refined = truth)::INT), 6) AS recall FROM t GROUP BY ALL")
def q_eval_by_class(spark, d):
    return rounded(metrics.by_class(triple(spark, d), ["sample"]), "recall")


@query("q_ari", f"WITH {eval_sql(['sample'])} SELECT sample, ari FROM res")
def q_ari(spark, d):
    return rounded(metrics.adjusted_rand(triple(spark, d), ["sample"]), "ari")


# Masks.
FACES = """n AS (SELECT a.*, turn, b.value AS other, b.mask_id IS NOT NULL AS there FROM m a CROSS JOIN (VALUES (0, -1, 0), (1, 1, 0), (2, 0, -1), (3, 0, 1)) f(turn, dr, dc)
  LEFT JOIN m b ON b.mask_id = a.mask_id AND b.r = a.r + dr AND b.c = a.c + dc WHERE a.value IS NOT NULL)"""
MASK = f"m AS ({fields.CELLS}), {FACES}"


@query("q_mask_boundary", f"WITH {MASK} SELECT mask_id, r, c, value, bool_or(coalesce(there AND other <> value, false)) AS boundary FROM n GROUP BY ALL")
def q_mask_boundary(spark, d):
    return masks.class_boundary(fields.mask(spark, d))


@query("q_mask_inner_boundary", f"WITH {MASK} SELECT mask_id, r, c, value, bool_or(there AND (other IS NULL OR other <> value)) AS inner FROM n GROUP BY ALL")
def q_mask_inner_boundary(spark, d):
    return masks.inner_boundary(fields.mask(spark, d))


@query(
    "q_mask_adjacent",
    f"""WITH {MASK}, f AS (SELECT mask_id, r, c, other, min(turn) AS t FROM n WHERE other IS NOT NULL AND other <> value GROUP BY ALL),
g AS (SELECT mask_id, r, c, string_agg(other, ',' ORDER BY t) AS near FROM f GROUP BY ALL) SELECT m.mask_id, m.r, m.c, m.value, coalesce(near, '') AS near FROM m LEFT JOIN g USING (mask_id, r, c) WHERE m.value IS NOT NULL""",
)
def q_mask_adjacent(spark, d):
    return masks.adjacent_classes(fields.mask(spark, d)).withColumn("near", F.array_join("near", ","))


def mask_levels(spark, d) -> list[str]:
    return few(table(spark, d, "part").select("p_type").distinct(), "levels")


@query(
    "q_mask_clean",
    chain(f"SELECT 'all' AS sample, CAST(r + (c - 1) * 50 AS BIGINT) AS id, CAST(r AS DOUBLE) AS x, CAST(c AS DOUBLE) AS y, CAST(dense_rank() OVER (ORDER BY value) AS INTEGER) AS code FROM ({fields.CELLS}) WHERE value IS NOT NULL", 2, 6)
    + f""", done AS ({FINAL}), names AS (SELECT value, CAST(row_number() OVER (ORDER BY value) AS INTEGER) AS code FROM (SELECT DISTINCT p_type AS value FROM part))
SELECT s.mask_id, s.r, s.c, s.value, a.value AS cleaned, b.value AS candidate, margin_score, required, repair_margin, atlas_dispersion, isolation, changed
FROM ({fields.CELLS}) s LEFT JOIN done ON done.id = s.r + (s.c - 1) * 50 AND s.value IS NOT NULL LEFT JOIN names a ON a.code = done.refined LEFT JOIN names b ON b.code = done.candidate""",
)
def q_mask_clean(spark, d):
    return rounded(masks.clean_mask(fields.mask(spark, d), mask_levels(spark, d)), "margin_score", "required", "repair_margin", "atlas_dispersion", "isolation")


# A corrupted mask and one that undoes part of it.
DAMAGED = f"""SELECT mask_id, r, c, value AS truth, CASE WHEN value IS NULL THEN NULL WHEN {u_sql(3, 'hit', 'r * 1000 + c')} < 0.2 THEN other ELSE value END AS initial,
CASE WHEN value IS NULL THEN NULL WHEN {u_sql(3, 'hit', 'r * 1000 + c')} < 0.2 AND {u_sql(3, 'back', 'r * 1000 + c')} < 0.5 THEN value WHEN {u_sql(3, 'hit', 'r * 1000 + c')} < 0.2 OR {u_sql(3, 'harm', 'r * 1000 + c')} < 0.03 THEN other ELSE value END AS refined
FROM (SELECT *, (SELECT min(value) FROM ({fields.CELLS}) q) AS other FROM ({fields.CELLS}))"""


def damaged(spark, d):
    cells = fields.mask(spark, d)
    other = cells.agg(F.min("value").alias("other"))
    cells = cells.crossJoin(F.broadcast(other)).withColumn("key", F.col("r") * 1000 + F.col("c"))  # one row
    hit, back, harm = (uniform(3, s, "key") for s in ("hit", "back", "harm"))
    value = F.col("value")
    initial = F.when(value.isNull(), None).when(hit < 0.2, F.col("other")).otherwise(value)
    refined = F.when(value.isNull(), None).when((hit < 0.2) & (back < 0.5), value).when((hit < 0.2) | (harm < 0.03), F.col("other")).otherwise(value)
    return tuple(cells.select("mask_id", "r", "c", x.alias("value")) for x in (value, initial, refined))


IOU = f"""WITH dm AS ({DAMAGED}), f AS (SELECT * FROM dm WHERE truth IS NOT NULL),
ref AS (SELECT mask_id, truth AS class, count(*) AS ref, count(*) FILTER (refined = truth) AS common FROM f GROUP BY ALL), pr AS (SELECT mask_id, refined AS class, count(*) AS pred FROM f GROUP BY ALL),
o AS (SELECT ref.mask_id, class, ref, common, coalesce(pred, 0) AS pred, common / (ref + coalesce(pred, 0) - common) AS iou, 2 * common / (ref + coalesce(pred, 0)) AS dice FROM ref LEFT JOIN pr USING (mask_id, class))"""


@query("q_mask_iou", f"{IOU} SELECT mask_id, class, ref, common, CAST(pred AS BIGINT) AS pred, round(iou, 6) AS iou, round(dice, 6) AS dice FROM o")
def q_mask_iou(spark, d):
    truth, _, refined = damaged(spark, d)
    frame = truth.where("value is not null").withColumnRenamed("value", "truth").join(refined.withColumnRenamed("value", "refined"), ["mask_id", "r", "c"])
    return rounded(masks.class_overlap(frame, ["mask_id"]), "iou", "dice")


def inner_sql(column: str, out: str) -> str:
    return f"""{out} AS (SELECT DISTINCT a.mask_id, a.r, a.c, a.{column} AS value FROM dm a JOIN dm b ON b.mask_id = a.mask_id AND abs(a.r - b.r) + abs(a.c - b.c) = 1 WHERE a.{column} IS NOT NULL AND (b.{column} IS NULL OR b.{column} <> a.{column}))"""


BAND = f"""{inner_sql('truth', 'ba')}, {inner_sql('refined', 'bb')},
bi AS (SELECT mask_id, value AS class, count(*) FILTER (x AND y) AS common, count(*) AS either FROM (SELECT coalesce(ba.mask_id, bb.mask_id) AS mask_id, coalesce(ba.value, bb.value) AS value, ba.r IS NOT NULL AS x, bb.r IS NOT NULL AS y FROM ba FULL JOIN bb USING (mask_id, r, c, value)) GROUP BY ALL)"""


@query("q_mask_boundary_iou", f"{IOU}, {BAND} SELECT mask_id, class, common, either, round(common / either, 6) AS boundary_iou FROM (SELECT DISTINCT mask_id, truth AS class FROM f) LEFT JOIN bi USING (mask_id, class)")
def q_mask_boundary_iou(spark, d):
    truth, _, refined = damaged(spark, d)
    return rounded(masks.boundary_overlap(truth, refined), "boundary_iou")


@query(
    "q_mask_identity",
    f"""{IOU}, {BAND},
s AS (SELECT mask_id, avg(iou) AS mean_iou, min(iou) AS worst_iou, sum(iou * ref) / sum(ref) AS fw, avg(dice) AS macro_dice, arg_min(class, (ref, class)) AS rare_class, arg_min(iou, (ref, class)) AS rare_iou FROM o GROUP BY ALL),
e AS (SELECT DISTINCT a.r, a.c FROM f a JOIN f b ON abs(a.r - b.r) + abs(a.c - b.c) = 1 AND a.truth <> b.truth),
q AS (SELECT f.mask_id, count(*) AS n, avg((initial = truth)::INT) AS ia, avg((refined = truth)::INT) AS acc, avg((e.r IS NOT NULL)::INT) AS bf, avg((refined = truth AND initial <> truth)::INT) AS rep, avg((refined <> truth AND initial = truth)::INT) AS dam FROM f LEFT JOIN e USING (r, c) GROUP BY ALL)
SELECT mask_id, n, round(ia, 6) AS initial_accuracy, round(acc, 6) AS accuracy, round(mean_iou, 6) AS mean_iou, round(worst_iou, 6) AS worst_iou, round(fw, 6) AS frequency_weighted_iou, round(macro_dice, 6) AS macro_dice, rare_class, round(rare_iou, 6) AS rare_class_iou,
round((SELECT avg(common / either) FROM bi JOIN (SELECT DISTINCT mask_id, truth AS class FROM f) USING (mask_id, class)), 6) AS mean_boundary_iou, round(bf, 6) AS boundary_fraction, round(rep, 6) AS repaired_fraction, round(dam, 6) AS damaged_fraction, round(abs((acc - ia) - (rep - dam)), 6) AS repair_identity_error
FROM s JOIN q USING (mask_id)""",
)
def q_mask_identity(spark, d):
    out = masks.evaluate_cleaning(*damaged(spark, d))
    doubles = ["initial_accuracy", "accuracy", "mean_iou", "worst_iou", "frequency_weighted_iou", "macro_dice", "rare_class_iou", "mean_boundary_iou", "boundary_fraction", "repaired_fraction", "damaged_fraction", "repair_identity_error"]
    return rounded(out, *doubles).select("mask_id", "n", "rare_class", *doubles)
