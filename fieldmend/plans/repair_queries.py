"""Queries of the repair operator, step by step, with SQL by other formulas where there are any."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmend.functions import geometry as G
from fieldmend.operators import repair as R
from fieldmend.plans import fields
from fieldmend.plans.registry import query, rounded
from fieldmend.sources.points import catalogue

A = {2: ("x", "y"), 3: ("x", "y", "z")}


def unit_sql(points: str, dims: int) -> str:
    cuts = ", ".join(f"quantile_cont({a}, 0.01) AS lo{a}, quantile_cont({a}, 0.99) AS hi{a}" for a in A[dims])
    scaled = ", ".join(f"least(1.1, greatest(-0.1, ({a} - lo{a}) / greatest(hi{a} - lo{a}, 1e-12))) AS u{a}" for a in A[dims])
    return f"pts AS ({points}), cuts AS (SELECT sample, {cuts} FROM pts GROUP BY sample), unit AS (SELECT p.*, {scaled} FROM pts p JOIN cuts USING (sample))"


def chart_sql(dims: int) -> str:
    d = range(dims)
    rows = ", ".join(f"({c}, " + ", ".join(repr(G.rotation(dims, c)[j][k]) + "::DOUBLE" for j in d for k in d) + ")" for c in range(G.CHARTS[dims]))
    names = ", ".join(f"r{j}{k}" for j in d for k in d)
    turned = ", ".join(" + ".join(f"u{A[dims][j]} * r{j}{k}" for j in d) + f" AS t{k}" for k in d)
    return f"rot(chart, {names}) AS (VALUES {rows}), charted AS (SELECT unit.*, chart, {turned} FROM unit, rot)"


def code_sql(dims: int) -> str:
    """Hilbert codes by a select per bit."""
    d = range(dims)
    over = "OVER (PARTITION BY sample, chart)"
    cell = ", ".join(f"CAST(floor(greatest(0.0, least(1.0 - 1e-12, (t{k} - min(t{k}) {over}) / greatest(max(t{k}) {over} - min(t{k}) {over}, 1e-12))) * 65535) AS BIGINT) AS a{k}" for k in d)
    sql = f"SELECT sample, chart, id, {cell} FROM charted"
    others = "sample, chart, id"
    for b in range(15, 0, -1):
        q = 1 << b
        sql = f"SELECT {others}, CASE WHEN a0 & {q} <> 0 THEN xor(a0, {q - 1}) ELSE a0 END AS a0, {', '.join(f'a{k}' for k in d[1:])} FROM ({sql})"
        for k in d[1:]:
            rest = "".join(f", a{j}" for j in d[1:] if j != k)
            swap = f"(xor(a0, a{k}) & {q - 1})"
            sql = f"SELECT {others}, CASE WHEN a{k} & {q} <> 0 THEN xor(a0, {q - 1}) ELSE xor(a0, {swap}) END AS a0, CASE WHEN a{k} & {q} <> 0 THEN a{k} ELSE xor(a{k}, {swap}) END AS a{k}{rest} FROM ({sql})"
    gray = {0: "a0"}
    for k in d[1:]:
        gray[k] = f"xor(a{k}, {gray[k - 1]})"
    sql = f"SELECT {others}, {', '.join(f'{gray[k]} AS a{k}' for k in d)} FROM ({sql})"
    fix = "0"
    for b in range(15, 0, -1):
        fix = f"xor({fix}, CASE WHEN a{dims - 1} & {1 << b} <> 0 THEN {(1 << b) - 1} ELSE 0 END)"
    sql = f"SELECT {others}, {', '.join(f'xor(a{k}, fix) AS a{k}' for k in d)} FROM (SELECT *, {fix} AS fix FROM ({sql}))"
    code = " + ".join(f"((a{k} >> {b}) & 1) * {1 << (b * dims + dims - 1 - k)}" for b in range(16) for k in d)
    keep = ", ".join(f"u.u{a}" for a in A[dims])
    return f"codes AS (SELECT u.sample, chart, u.id, u.code, {keep}, {code} AS hcode FROM ({sql}) h JOIN unit u ON u.sample = h.sample AND u.id = h.id)"


def step_sql(dims: int) -> str:
    over = "OVER (PARTITION BY sample, chart ORDER BY hcode, id)"

    def dist(f: str) -> str:
        return "sqrt(" + " + ".join(f"(u{a} - {f}(u{a}) {over}) * (u{a} - {f}(u{a}) {over})" for a in A[dims]) + ")"

    return f"""steps AS (SELECT *, {dist('lag')} AS step_in, {dist('lead')} AS step_out, row_number() {over} AS pos FROM codes),
refs AS (SELECT sample, chart, coalesce(median(step_in) FILTER (step_in > 1e-12), 1.0) AS ref FROM steps GROUP BY ALL),
scaled AS (SELECT s.*, ref, coalesce(step_in, 0.0) / greatest(ref, 1e-12) AS act_f, coalesce(step_out, 0.0) / greatest(ref, 1e-12) AS act_r,
  greatest(1.0, coalesce(CASE WHEN step_in IS NULL THEN greatest(step_out, 1e-12) WHEN step_out IS NULL THEN greatest(step_in, 1e-12)
    ELSE sqrt(greatest(step_in, 1e-12) * greatest(step_out, 1e-12)) END, ref) / greatest(ref, 1e-12)) AS iso
  FROM steps s JOIN refs USING (sample, chart)),
placed AS (SELECT *, sum(act_f) OVER (PARTITION BY sample, chart ORDER BY hcode, id) / 5.0 AS t FROM scaled)"""


def field_sql(classes: int) -> str:
    """Evidence by all pairs of a path: a row per point and class."""
    return f"""classes AS (SELECT CAST(unnest(range(1, {classes + 1})) AS INTEGER) AS cls),
pairs AS (SELECT a.sample, a.chart, a.id, b.code AS cls, sum(CASE WHEN b.pos < a.pos THEN exp(b.t - a.t) ELSE 0 END) AS f,
    sum(CASE WHEN b.pos > a.pos THEN exp(a.t - b.t) ELSE 0 END) AS r
  FROM placed a JOIN placed b ON a.sample = b.sample AND a.chart = b.chart AND a.id <> b.id GROUP BY ALL),
field AS (SELECT p.sample, p.chart, p.id, p.code, p.iso, c.cls, coalesce(f + r + 2 * sqrt(f * r), 0.0) AS e
  FROM placed p CROSS JOIN classes c LEFT JOIN pairs q ON q.sample = p.sample AND q.chart = p.chart AND q.id = p.id AND q.cls = c.cls),
margins AS (SELECT *, CAST(e / total - own AS FLOAT) AS m FROM (SELECT *, greatest(sum(e) OVER w, 1e-12) AS total,
    sum(CASE WHEN cls = code THEN e ELSE 0 END) OVER w / greatest(sum(e) OVER w, 1e-12) AS own
  FROM field WINDOW w AS (PARTITION BY sample, chart, id)))"""


def decide_sql(dims: int) -> str:
    return f"""agg AS (SELECT sample, id, code, cls, avg(m::DOUBLE) AS margin, 2 * sqrt(var_pop(m::DOUBLE)) / sqrt({G.CHARTS[dims]}.0) AS dispersion, median(iso::FLOAT::DOUBLE) AS isolation FROM margins GROUP BY ALL),
cnt AS (SELECT sample, code AS cls, count(*) AS n FROM unit GROUP BY ALL),
mid AS (SELECT sample, greatest(median(n), 1) AS mid FROM cnt GROUP BY sample),
rival AS (SELECT * FROM agg QUALIFY row_number() OVER (PARTITION BY sample, id ORDER BY margin DESC, (cls <> code), cls) = 1),
proof AS (SELECT r.sample, r.id, r.code, r.cls AS candidate, r.margin AS margin_score,
    dispersion / sqrt(mid / greatest(coalesce(n, 1), 1)) * isolation AS required, dispersion AS atlas_dispersion, isolation
  FROM rival r JOIN mid USING (sample) LEFT JOIN cnt c ON c.sample = r.sample AND c.cls = r.cls)"""


def ballot_sql(dims: int) -> str:
    d2 = " + ".join(f"(a.u{x} - b.u{x}) * (a.u{x} - b.u{x})" for x in A[dims])
    return f"""near AS (SELECT * FROM (SELECT a.sample, a.id, a.code, b.code AS vote, row_number() OVER (PARTITION BY a.sample, a.id ORDER BY {d2}, b.id) AS k
    FROM unit a JOIN unit b ON a.sample = b.sample AND a.id <> b.id) WHERE k <= {2 ** (dims + 4)}),
ballot AS (SELECT sample, id, code, count(*) FILTER (vote = code) AS mine, count(*) FILTER (vote <> code) AS other FROM near GROUP BY ALL),
proof AS (SELECT sample, id, code, CASE WHEN other > mine THEN 3 - code ELSE code END AS candidate, greatest(other - mine, 0)::DOUBLE AS margin_score,
  1.0::DOUBLE AS required, 0.0::DOUBLE AS atlas_dispersion, 1.0::DOUBLE AS isolation FROM ballot)"""


FINAL = """SELECT sample, id, code, CAST(CASE WHEN candidate <> code AND margin_score >= required THEN candidate ELSE code END AS INTEGER) AS refined, CAST(candidate AS INTEGER) AS candidate,
round(margin_score, 6) + 0.0 AS margin_score, round(required, 6) + 0.0 AS required, round(atlas_dispersion, 6) + 0.0 AS atlas_dispersion, round(isolation, 6) + 0.0 AS isolation,
round(margin_score - required, 6) + 0.0 AS repair_margin, candidate <> code AND margin_score >= required AS changed FROM proof"""


def chain(points: str, dims: int, classes: int = fields.EMB_CLASSES, *, until: str = "proof") -> str:
    steps = [("unit", unit_sql(points, dims)), ("charted", chart_sql(dims)), ("codes", code_sql(dims)), ("placed", step_sql(dims)), ("margins", field_sql(classes)), ("proof", decide_sql(dims))]
    names = [n for n, _ in steps]
    return "WITH " + ", ".join(s for _, s in steps[: names.index(until) + 1])


def finished(df):
    return rounded(df, "margin_score", "required", "atlas_dispersion", "isolation", "repair_margin")


def _unit(spark, d, dims=2):
    """The embeddings' unit coordinates, and how many points the largest specimen has."""
    points = fields.embeddings(spark, d)
    stats, rows = G.specimens(points, dims)
    return G.robust_unit(points, dims, stats), max(r["n"] for r in rows)


def _scaled(spark, d, dims=2):
    unit, largest = _unit(spark, d, dims)
    return R.path_scale(R.path_steps(R.chart_codes(unit, dims), dims, largest), largest), largest


def _field(spark, d):
    scaled, largest = _scaled(spark, d)
    whole = largest <= R.RUN_ROWS
    return R.enclosure(R.path_place(scaled, whole), fields.EMB_CLASSES, whole)


@query(
    "q_catalog",
    f"""SELECT dataset, true AS included, CAST(count(*) AS INTEGER) AS observations, CAST(count(DISTINCT code) AS INTEGER) AS classes, 60 AS scenarios
FROM (SELECT 'customers' AS dataset, code FROM ({fields.CUST}) UNION ALL SELECT 'embeddings', code FROM ({fields.EMB}) UNION ALL SELECT 'orders', code FROM ({fields.ORD})) GROUP BY dataset""",
)
def q_catalog(spark, d):
    """The catalogue of the fields over the supplied tables, each of which the recipe of sixty scenarios applies to."""
    return catalogue({"customers": fields.customers(spark, d), "embeddings": fields.embeddings(spark, d), "orders": fields.orders(spark, d)})


@query("q_robust_scale", f"WITH {unit_sql(fields.ORD, 2)} SELECT sample, id, round(ux, 6) + 0.0 AS ux, round(uy, 6) + 0.0 AS uy FROM unit")
def q_robust_scale(spark, d):
    return rounded(G.robust_unit(fields.orders(spark, d), 2), "ux", "uy").select("sample", "id", "ux", "uy")


def _charts(name: str, dims: int, points: str, source):
    t = [f"t{k}" for k in range(dims)]
    sql = f"{chain(points, dims, until='charted')} SELECT sample, chart, id, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in t)} FROM charted"

    @query(name, sql)
    def run(spark, d):
        return rounded(G.charts(G.robust_unit(source(spark, d), dims), dims), *t).select("sample", "chart", "id", *t)

    return run


_charts("q_rotate_charts", 2, fields.PART, fields.parts)
_charts("q_rotate_charts_3d", 3, fields.EMB, fields.embeddings)


def _codes(name: str, dims: int, points: str, source):
    @query(name, f"{chain(points, dims, until='codes')} SELECT sample, chart, id, hcode FROM codes")
    def run(spark, d):
        return R.chart_codes(G.robust_unit(source(spark, d), dims), dims).select("sample", "chart", "id", "hcode")

    return run


_codes("q_hilbert_2d", 2, fields.PART.replace("AS y FROM", "AS y, 1 AS code FROM"), lambda s, d: fields.parts(s, d).withColumn("code", F.lit(1)))
_codes("q_hilbert_3d", 3, fields.EMB, fields.embeddings)


@query("q_chart_order", f"{chain(fields.EMB, 2, until='placed')} SELECT sample, chart, id, pos FROM placed")
def q_chart_order(spark, d):
    from pyspark.sql import Window

    over = Window.partitionBy("sample", "chart").orderBy("hcode", "id")
    return R.chart_codes(_unit(spark, d)[0], 2).select("sample", "chart", "id", F.row_number().over(over).cast("long").alias("pos"))


STEP = ["step_in", "step_out", "ref", "act_f", "act_r"]


@query("q_path_steps", f"{chain(fields.EMB, 2, until='placed')} SELECT sample, chart, id, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in STEP)} FROM placed")
def q_path_steps(spark, d):
    return rounded(_scaled(spark, d)[0], *STEP).select("sample", "chart", "id", *STEP)


@query("q_isolation", f"{chain(fields.EMB, 2, until='placed')} SELECT sample, id, round(median(iso::FLOAT::DOUBLE), 6) AS isolation FROM placed GROUP BY sample, id")
def q_isolation(spark, d):
    scaled, _ = _scaled(spark, d)
    return rounded(scaled.groupBy("sample", "id").agg(F.percentile(F.col("iso").cast("float").cast("double"), 0.5).alias("isolation")), "isolation")


def _long(df, prefix: str, out: str):
    cols = F.array(*(F.struct(F.lit(c).alias("cls"), F.col(f"{prefix}{c}").cast("double").alias(out)) for c in range(1, fields.EMB_CLASSES + 1)))
    return df.select("sample", "chart", "id", F.explode(cols).alias("v")).select("sample", "chart", "id", "v.*")


@query("q_enclosure_field", f"{chain(fields.EMB, 2, until='margins')} SELECT sample, chart, id, cls, round(e, 6) + 0.0 AS e FROM field")
def q_enclosure_field(spark, d):
    return rounded(_long(_field(spark, d), "e", "e"), "e")


@query("q_share_margin", f"{chain(fields.EMB, 2, until='margins')} SELECT sample, chart, id, cls, round(m::DOUBLE, 5) + 0.0 AS m FROM margins")
def q_share_margin(spark, d):
    field = R.share_margins(_field(spark, d), fields.EMB_CLASSES)
    return rounded(_long(field, "m", "m"), "m", digits=5)


@query("q_chart_dispersion", f"{chain(fields.EMB, 2)} SELECT sample, id, cls, round(margin, 6) + 0.0 AS margin, round(dispersion, 6) + 0.0 AS dispersion FROM agg")
def q_chart_dispersion(spark, d):
    field = R.share_margins(_field(spark, d), fields.EMB_CLASSES)
    both = R.over_charts(field, fields.EMB_CLASSES, 2).select("sample", "id", F.posexplode(F.arrays_zip("margin", "dispersion")).alias("p", "v"))
    return rounded(both.select("sample", "id", (F.col("p") + 1).cast("int").alias("cls"), "v.margin", "v.dispersion"), "margin", "dispersion")


@query("q_class_deficit", f"WITH pts AS ({fields.EMB}), cnt AS (SELECT sample, code, count(*) AS n FROM pts GROUP BY ALL), mid AS (SELECT sample, greatest(median(n), 1) AS mid FROM cnt GROUP BY sample) SELECT sample, code, round(sqrt(mid / greatest(n, 1)), 6) AS deficit FROM cnt JOIN mid USING (sample)")
def q_class_deficit(spark, d):
    deficits = R.class_deficit(fields.embeddings(spark, d)).select("sample", F.explode("deficits").alias("code", "deficit"))
    return rounded(deficits, "deficit")


def _all_sample(spark, d):
    return fields.embeddings(spark, d).withColumn("sample", F.lit("all"))


@query("q_repair_multiclass", f"{chain(fields.EMB.replace('CAST(vec_id % 3 AS VARCHAR)', chr(39) + 'all' + chr(39)), 2)} {FINAL}")
def q_repair_multiclass(spark, d):
    return finished(R.repair(_all_sample(spark, d), 2, fields.EMB_CLASSES))


@query("q_repair_multisample", f"{chain(fields.EMB, 2)} {FINAL}")
def q_repair_multisample(spark, d):
    return finished(R.repair(fields.embeddings(spark, d), 2, fields.EMB_CLASSES))


@query("q_repair_3d", f"{chain(fields.EMB, 3)} {FINAL}")
def q_repair_3d(spark, d):
    return finished(R.repair(fields.embeddings(spark, d), 3, fields.EMB_CLASSES))


BIN_CUST = fields.CUST.replace(f"CAST(list_position({fields.CUST_LEVELS}, c_mktsegment) AS INTEGER)", "CASE WHEN c_mktsegment = 'AUTOMOBILE' OR c_acctbal < 2000 THEN 1 ELSE 2 END")


@query("q_repair_binary", f"WITH {unit_sql(BIN_CUST, 2)}, {ballot_sql(2)} {FINAL}")
def q_repair_binary(spark, d):
    points = fields.customers(spark, d).withColumn("code", F.when((F.col("code") == 1) | (F.col("x") < 2000), 1).otherwise(2))
    return finished(R.repair(points, 2, 2))


GATES = f"""SELECT sample, id, 1.0::DOUBLE AS x, 1.0::DOUBLE AS y, code FROM (SELECT 'flat' AS sample, id, code FROM ({fields.CUST}))
UNION ALL SELECT 'few' || (id // 10), id, x, y, code FROM ({fields.CUST})
UNION ALL SELECT 'one', id, x, y, 3 FROM ({fields.CUST})"""


@query(
    "q_repair_gates",
    f"WITH pts AS ({GATES}), proof AS (SELECT sample, id, code, code AS candidate, 0.0::DOUBLE AS margin_score, 0.0::DOUBLE AS required, 0.0::DOUBLE AS atlas_dispersion, 1.0::DOUBLE AS isolation FROM pts) {FINAL}",
)
def q_repair_gates(spark, d):
    """Specimens without extent, of fewer than 20 points, and of one class stay as they are."""
    base = fields.customers(spark, d)
    flat = base.select(F.lit("flat").alias("sample"), "id", F.lit(1.0).alias("x"), F.lit(1.0).alias("y"), "code")
    few = base.withColumn("sample", F.concat(F.lit("few"), F.floor(F.col("id") / 10).cast("string")))
    one = base.withColumns({"sample": F.lit("one"), "code": F.lit(3)})
    return finished(R.repair(flat.unionByName(few).unionByName(one), 2, 5))


@query(
    "q_repair_labels",
    f"""{chain(fields.EMB, 2)}, fin AS ({FINAL}) SELECT sample, id, chr(96 + code) AS label, chr(96 + refined) AS refined, chr(96 + candidate) AS candidate, margin_score, required, repair_margin, atlas_dispersion, isolation, changed FROM fin""",
)
def q_repair_labels(spark, d):
    """The public form, with text labels in and out; the levels are those that occur, in binary order."""
    points = fields.embeddings(spark, d).withColumn("label", F.char(F.col("code") + 96)).drop("code")
    return finished(R.repair_labels(points, 2))
