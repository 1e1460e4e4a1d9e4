"""Queries of matching, class metrics, splits, rasters and series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import layout as L
from ..operators import matching as A
from ..operators import metrics as M
from ..operators import raster as P
from ..operators import series as S
from ..operators import splits as D
from ..schema import REDUCED
from . import views as V
from .registry import query
from .text_queries import _rounded

W = "WITH "
_BOTH = f"{V.REGIONS}, {V.PREDICTED}"
_PAIRS = """pr AS (SELECT *, it / (a1 + a2 - it) AS iou FROM (SELECT p.page, p.label, p.ord AS p, g.ord AS g,
 (least(p.maxx, g.maxx) - greatest(p.minx, g.minx))::DOUBLE * (least(p.maxy, g.maxy) - greatest(p.miny, g.miny)) AS it, (p.maxx - p.minx)::DOUBLE * (p.maxy - p.miny) AS a1, (g.maxx - g.minx)::DOUBLE * (g.maxy - g.miny) AS a2
 FROM predicted p JOIN regions g ON p.page = g.page AND p.label = g.label AND p.minx < g.maxx AND g.minx < p.maxx AND p.miny < g.maxy AND g.miny < p.maxy))"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    truth = V.regions(spark, sf_dir)
    return V.predicted(truth), truth


@query("iou_pairs", W + f"{_BOTH}, {_PAIRS} SELECT page, label, p, g, round(iou, 6) AS iou FROM pr")
def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(A.pairs(*_sides(spark, sf_dir), ["page", "label"]))


def _matched(by: list[str], threshold: float) -> str:
    """Greedy matching as a walk over each key's ranked pairs: wk carries the places taken on both sides."""
    keys = ", ".join(by)
    of = lambda t: ", ".join(f"{t}.{k}" for k in by)
    same = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in by)
    free = "list_contains(w.ps, r.p) OR list_contains(w.gs, r.g)"
    return f"""WITH RECURSIVE {_BOTH}, pr AS (SELECT {keys}, p, g, it / (a1 + a2 - it) AS iou FROM (SELECT {of("p")}, p.ord AS p, g.ord AS g,
 (least(p.maxx, g.maxx) - greatest(p.minx, g.minx))::DOUBLE * (least(p.maxy, g.maxy) - greatest(p.miny, g.miny)) AS it, (p.maxx - p.minx)::DOUBLE * (p.maxy - p.miny) AS a1, (g.maxx - g.minx)::DOUBLE * (g.maxy - g.miny) AS a2
 FROM predicted p JOIN regions g ON {same("p", "g")} AND p.minx < g.maxx AND g.minx < p.maxx AND p.miny < g.maxy AND g.miny < p.maxy)),
rk AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY iou DESC, p, g) AS k FROM pr WHERE iou >= {threshold}::DOUBLE),
wk AS (SELECT {keys}, 0::BIGINT AS k, []::INT[] AS ps, []::INT[] AS gs FROM (SELECT DISTINCT {keys} FROM rk)
 UNION ALL SELECT {of("w")}, r.k, CASE WHEN {free} THEN w.ps ELSE list_append(w.ps, r.p) END, CASE WHEN {free} THEN w.gs ELSE list_append(w.gs, r.g) END FROM wk w JOIN rk r ON {same("w", "r")} AND r.k = w.k + 1),
hit AS (SELECT {keys}, arg_max(ps, k) AS ps, arg_max(gs, k) AS gs FROM wk GROUP BY {keys}),
"""


_RATE = """CASE WHEN tp + fp = 0 THEN 1 ELSE tp::DOUBLE / (tp + fp) END AS precision, CASE WHEN n_gt = 0 THEN 1 ELSE tp::DOUBLE / n_gt END AS recall"""
_F1 = "CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1"


def _counted(by: list[str], threshold: float) -> str:
    keys = ", ".join(by)
    return f"""{_matched(by, threshold)} sz AS (SELECT {keys}, sum(np)::BIGINT AS np, sum(ng)::BIGINT AS ng FROM (SELECT {keys}, 1 AS np, 0 AS ng FROM predicted UNION ALL SELECT {keys}, 0, 1 FROM regions) GROUP BY {keys}),
ct AS (SELECT {keys}, coalesce(len(ps), 0)::BIGINT AS tp, np - coalesce(len(ps), 0)::BIGINT AS fp, ng - coalesce(len(ps), 0)::BIGINT AS fn, ng AS n_gt FROM sz LEFT JOIN hit USING ({keys})),
rt AS (SELECT *, {_F1} FROM (SELECT *, {_RATE} FROM ct))"""


def _sums(more: str) -> str:
    return f"{more}sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(n_gt)::BIGINT AS n_gt"


_EVERY = f"al AS (SELECT page, NULL::INT AS label, {_sums('')} FROM ct GROUP BY page)"
_MICRO = "SELECT * EXCLUDE (precision, recall), round(precision, 6) AS micro_precision, round(recall, 6) AS micro_recall, round(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS micro_f1 FROM (SELECT *, " + _RATE + " FROM sm)"
_RATES = ("precision", "recall", "f1")
_LAYOUT = ", ".join(f"round(avg({m}), 6) AS {m}_mean, round(median({m}), 6) AS {m}_median, round(stddev_pop({m}), 6) AS {m}_std" for m in _RATES)
_LINES = ", ".join(f"round(avg({m}), 6) AS {m}_mean, round(quantile_disc({m}, 0.5), 6) AS {m}_median, round(stddev_samp({m}), 6) AS {m}_std, round(min({m}), 6) AS {m}_min, round(max({m}), 6) AS {m}_max" for m in _RATES)


@query("layout_match", f"{_counted(['page', 'label'], 0.5)}, {_EVERY} SELECT * FROM rt UNION ALL SELECT *, {_F1} FROM (SELECT *, {_RATE} FROM al)")
def layout_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.compared(*_sides(spark, sf_dir), 0.5)


@query("layout_summary", f"{_counted(['page', 'label'], 0.5)}, sm AS (SELECT label, {_LAYOUT}, {_sums('')} FROM rt GROUP BY label) {_MICRO}")
def layout_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(A.summary(A.compared(*_sides(spark, sf_dir), 0.5).where("label is not null"), ["label"]))


@query("textline_match", f"{_counted(['page'], 0.7)} SELECT * FROM rt")
def textline_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.counted(*_sides(spark, sf_dir), ["page"], 0.7)


@query("textline_summary", f"{_counted(['page'], 0.7)}, sm AS (SELECT {_LINES}, {_sums('')} FROM rt) {_MICRO}")
def textline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(A.line_summary(A.counted(*_sides(spark, sf_dir), ["page"], 0.7)))


@query("textline_alignment", f"""{_matched(["page"], 0)} mt AS (SELECT page, unnest(ps) AS p, unnest(gs) AS g FROM hit)
SELECT a.page, a.ord AS p, mt.g FROM predicted a LEFT JOIN mt ON a.page = mt.page AND a.ord = mt.p
UNION ALL SELECT b.page, NULL, b.ord FROM regions b WHERE NOT EXISTS (SELECT 1 FROM mt WHERE mt.page = b.page AND mt.g = b.ord)""")
def textline_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.aligned(*_sides(spark, sf_dir), ["page"])


_TOP = "list_max(score)"
_DECIDED = f"CASE WHEN {_TOP} < 0.1::DOUBLE THEN 0 ELSE list_position(score, {_TOP}) - 1 END::INT"
_CM = f"{V.SCORES}, d AS (SELECT id, target, {_DECIDED} AS pred FROM scores), cm AS (SELECT target, pred, count(*) AS n FROM d GROUP BY 1, 2)"
_CLS = f"""{_CM}, ls AS (SELECT range::INT AS label FROM range(10)), t AS (SELECT target AS label, sum(n) AS n FROM cm GROUP BY 1), p AS (SELECT pred AS label, sum(n) AS n FROM cm GROUP BY 1), h AS (SELECT target AS label, n FROM cm WHERE target = pred),
k AS (SELECT label, coalesce(t.n, 0)::BIGINT AS n_target, coalesce(p.n, 0)::BIGINT AS n_pred, coalesce(h.n, 0)::BIGINT AS hits FROM ls LEFT JOIN t USING (label) LEFT JOIN p USING (label) LEFT JOIN h USING (label)),
cl AS (SELECT *, hits::DOUBLE / nullif(n_target + n_pred - hits, 0) AS csi, hits::DOUBLE / nullif(n_pred, 0) AS precision, hits::DOUBLE / nullif(n_target, 0) AS recall, 2 * hits::DOUBLE / nullif(n_target + n_pred, 0) AS f1 FROM k)"""


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.scores(spark, sf_dir).withColumn("pred", L.decided(F.col("score"), 0.1))


@query("class_decision", W + f"{_CM} SELECT id, target, pred FROM d")
def class_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).select("id", "target", "pred")


@query("uncertain", W + f"{V.SCORES} SELECT id, (score[target + 1] < 0.05::DOUBLE)::INT AS uncertain FROM scores")
def uncertain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.scores(spark, sf_dir).select("id", L.uncertain(F.col("score"), F.col("target"), 0.05).alias("uncertain"))


@query("class_reduce", W + f"{V.SCORES} SELECT id, CASE WHEN target IN ({', '.join(map(str, REDUCED[3]))}) THEN 3 WHEN target IN ({', '.join(map(str, REDUCED[0]))}) THEN 0 ELSE target END AS target, round(score[1] + score[9] + score[10], 6) AS s0, round(score[4] + score[2] + score[6], 6) AS s3 FROM scores")
def class_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = L.reduced_scores(F.col("score"))
    return V.scores(spark, sf_dir).select("id", L.reduced(F.col("target")).alias("target"), F.round(F.get(s, F.lit(0)), 6).alias("s0"), F.round(F.get(s, F.lit(3)), 6).alias("s3"))


@query("softmax_top", W + f"{V.SCORES} SELECT id, round(1 / list_sum(list_transform(score, lambda x: exp(x - list_max(score)))), 6) AS p FROM scores")
def softmax_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.scores(spark, sf_dir).select("id", F.round(F.array_max(L.softmax(F.col("score"))), 6).alias("p"))


@query("class_histogram", W + f"{V.SCORES} SELECT range::INT AS label, coalesce(n, 0)::BIGINT AS n, round(coalesce(n, 0) / (SELECT count(*) FROM scores), 6) AS ratio FROM range(10) LEFT JOIN (SELECT target, count(*) AS n FROM scores GROUP BY 1) ON range = target")
def class_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.histogram(V.scores(spark, sf_dir), "target"))


@query("confusion", W + f"{_CM} SELECT target, pred, n FROM cm")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.confusion(_decided(spark, sf_dir), "target", "pred")


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.class_metrics(confusion(spark, sf_dir))


@query("class_prf", W + f"{_CLS} SELECT label, n_target, n_pred, hits, round(coalesce(csi, -1), 6) AS csi, round(coalesce(precision, -1), 6) AS precision, round(coalesce(recall, -1), 6) AS recall, round(coalesce(f1, -1), 6) AS f1, greatest(n_target, n_pred) AS weight FROM cl")
def class_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _classes(spark, sf_dir)
    return _rounded(df.withColumns({c: F.nanvl(c, F.lit(-1.0)) for c in ("csi", "precision", "recall", "f1")}))


@query("weighted_metrics", W + f"{_CLS} SELECT round(sum(hits) / sum(n_target), 6) AS accuracy, round(sum(n_target * coalesce(csi, 0)) / sum(n_target), 6) AS weighted_jaccard, round(avg(csi), 6) AS mean_csi, round(sum((1 - coalesce(csi, 0)) ** 2), 6) AS stop_score FROM cl")
def weighted_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(M.overall(_classes(spark, sf_dir)))


@query("weighted_f1", W + f"{_CLS} SELECT round(sum(f1 * greatest(n_target, n_pred)) / sum(CASE WHEN f1 IS NOT NULL THEN greatest(n_target, n_pred) END), 6) AS f1 FROM cl")
def weighted_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_classes(spark, sf_dir).agg(M.weighted_mean(F.col("f1"), F.col("weight")).alias("f1")))


_RANK = "r AS (SELECT *, row_number() OVER (ORDER BY md5(doc_id::VARCHAR), doc_id) AS rank, count(*) OVER () AS n FROM documents)"


@query("split_exact", W + f"{_RANK} SELECT doc_id, CASE WHEN rank <= trunc(0.85 * n) THEN 'Training' WHEN rank <= trunc(0.85 * n) + trunc(0.05 * n) THEN 'Validation' ELSE 'Test' END AS split FROM r")
def split_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.split_exact(V.read(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", "split")


@query("sample_lines", W + f"{_RANK} SELECT doc_id FROM r WHERE rank <= 100")
def sample_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.sample(V.read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100)[0]


@query("sample_remaining", W + f"{_RANK} SELECT doc_id FROM r WHERE rank > 100")
def sample_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.sample(V.read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100)[1]


@query("todo_files", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def todo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.todo(V.read(spark, sf_dir, "documents").select("doc_id"), V.read(spark, sf_dir, "labels"), "doc_id")


@query("missing_targets", "SELECT count(*) > 0 AS missing FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = V.read(spark, sf_dir, "documents").select("doc_id"), V.read(spark, sf_dir, "labels").select("doc_id")
    return docs.join(labels, "doc_id", "left_anti").limit(1).agg((F.count(F.lit(1)) > 0).alias("missing"))


@query("limited_stems", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 30")
def limited_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.limited(V.read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 30)


@query("stem_join", "SELECT l.doc_id, d.source, d.lang, l.quality FROM labels l JOIN documents d USING (doc_id)")
def stem_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.read(spark, sf_dir, "labels").join(V.read(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id").select("doc_id", "source", "lang", "quality")


_SIZES = "s AS (SELECT page, (max(maxx))::INT AS width, (max(maxy))::INT AS height FROM regions GROUP BY page)"


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.regions(spark, sf_dir).groupBy("page").agg(F.max("maxx").alias("width"), F.max("maxy").alias("height"))


_PAD = "CASE WHEN {0} < 1024 THEN 1024 - {0} ELSE (512 - {0} % 512) % 512 END"


@query("pad_sizes", W + f"{V.REGIONS}, {_SIZES} SELECT page, {_PAD.format('width')} AS pad_x, {_PAD.format('height')} AS pad_y FROM s")
def pad_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sizes(spark, sf_dir).select("page", P.padding(F.col("width"), 1024, 2).alias("pad_x"), P.padding(F.col("height"), 1024, 2).alias("pad_y"))


@query("tile_origins", W + f"{V.REGIONS}, {_SIZES}, n AS (SELECT page, CASE WHEN width < 1024 THEN 0 ELSE (width - 1024) // 1024 + 1 END AS nx, CASE WHEN height < 1024 THEN 0 ELSE (height - 1024) // 1024 + 1 END AS ny FROM s) SELECT page, i::INT AS tile, (i // nx * 1024)::INT AS y, (i % nx * 1024)::INT AS x FROM (SELECT page, nx, unnest(range(0, nx * ny)) AS i FROM n WHERE nx * ny > 0)")
def tile_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.tiles(_sizes(spark, sf_dir), 1024).select("page", "tile", "y", "x")


@query("crop_sizes", W + f"{V.REGIONS} SELECT page, ord, ((maxx - minx) * 64 // (maxy - miny))::INT AS width FROM regions WHERE (maxx - minx) * 64 // (maxy - miny) >= 64")
def crop_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = P.crop_size(F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny"), 64)
    return V.regions(spark, sf_dir).select("page", "ord", w.alias("width")).where("width is not null")


@query("nms_vertical", "SELECT vec_id AS page, y::INT AS y, CASE WHEN v = max(v) OVER (PARTITION BY vec_id ORDER BY y ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) THEN v ELSE 0 END AS value FROM (SELECT vec_id, y - 1 AS y, embedding[y]::DOUBLE AS v FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS y FROM embeddings))")
def nms_vertical(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = V.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page"), F.lit(0).alias("x"), F.posexplode(F.expr("cast(embedding as array<double>)")).alias("y", "value"))
    return P.vertical_maxima(df, ["page"]).select("page", "y", "value")


@query("batch_by_width", W + f"{V.REGIONS} SELECT label, page, ord, ((row_number() OVER (PARTITION BY label ORDER BY maxx - minx, page * 100 + ord) - 1) // 32)::INT AS batch FROM regions")
def batch_by_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = V.regions(spark, sf_dir).withColumns({"width": F.col("maxx") - F.col("minx"), "id": F.col("page") * 100 + F.col("ord")})
    return P.batches_by_width(df, 32, ["label"]).select("label", "page", "ord", "batch")


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.read(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("tag"), F.col("event_id").alias("step"), "value", (F.col("event_id") / 20).cast("int").alias("epoch"))


_SERIES = "s AS (SELECT user_id AS run, event_type AS tag, event_id AS step, value, trunc(event_id / 20)::INT AS epoch FROM events)"


@query("series_final", W + f"{_SERIES} SELECT tag, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM (SELECT run, tag, arg_max(value, step) AS v FROM s GROUP BY 1, 2) GROUP BY tag")
def series_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.over_runs(_series(spark, sf_dir)))


@query("throughput", "SELECT user_id % 8 AS workers, round(avg(395 / (1 + event_id % 17)), 6) AS mean, round(stddev_pop(395 / (1 + event_id % 17)), 6) AS std FROM events GROUP BY 1")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = V.read(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("workers"), F.lit(395).alias("batches"), (1 + F.col("event_id") % 17).alias("duration"))
    return _rounded(S.throughput(df, ["workers"]))


@query("series_rebased", W + f"{_SERIES} SELECT run, tag, step, sum(CASE WHEN epoch > 200 THEN i / 2.0::DOUBLE ELSE i::DOUBLE END) OVER (PARTITION BY run, tag ORDER BY step ROWS UNBOUNDED PRECEDING) AS step_new FROM (SELECT *, step - coalesce(lag(step) OVER (PARTITION BY run, tag ORDER BY step), 0) AS i FROM s)")
def series_rebased(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rebased(_series(spark, sf_dir)).select("run", "tag", "step", "step_new")
