"""Errors, statistics, losses and class reports over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions.arrays import paired, total
from ..operators import classify, focal, losses, masks, metrics, transforms
from ..operators.ranks import quantiles
from .registry import PAIRS, TILES, query

_SIDE = model.SIDE
#: Every 17th pixel of the stand-in targets is made missing where a query is about missing values.
_SUM = "list_reduce({0}, lambda a, b: a + b)"


def _sum(expr: str) -> str:
    return f"list_reduce(list_concat([0.0::DOUBLE], list_transform(range(1, 65), lambda i: {expr})), lambda a, b: a + b)"


def _per_pair() -> str:
    return f"""{PAIRS},
        m AS (SELECT *, {_sum('t[i]')} / 64 AS mt, {_sum('p[i]')} / 64 AS mp FROM pairs),
        e AS (SELECT tile_id, site, {_sum('(t[i] - p[i]) * (t[i] - p[i])')} / 64 AS mse, {_sum('abs(t[i] - p[i])')} / 64 AS mae,
                     {_sum('(t[i] - mt) * (p[i] - mp)')} AS tp, sqrt({_sum('(t[i] - mt) * (t[i] - mt)')} * {_sum('(p[i] - mp) * (p[i] - mp)')}) AS norm FROM m),
        s AS (SELECT tile_id, site, mse, mae, sqrt(mse) AS rmse, CASE WHEN norm < 1e-10 THEN 0 ELSE tp / norm END AS zncc FROM e)"""


@query(f"""WITH {_per_pair()}
    SELECT site, count(*) AS n_tiles, round(avg(mse), 9) AS mse_mean, round(stddev_samp(mse), 9) AS mse_std, round(avg(mae), 9) AS mae_mean, round(stddev_samp(mae), 9) AS mae_std,
           round(avg(rmse), 9) AS rmse_mean, round(stddev_samp(rmse), 9) AS rmse_std, round(avg(zncc), 9) AS zncc_mean, round(stddev_samp(zncc), 9) AS zncc_std,
           round(avg(zncc * 63 / 64), 9) AS zncc_sample_mean, round(stddev_samp(zncc * 63 / 64), 9) AS zncc_sample_std FROM s GROUP BY site""")
def tile_pair_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.by_site(metrics.per_tile(model.pairs(spark, sf_dir)), ("mse", "mae", "rmse", "zncc", "zncc_sample"))


@query(f"""WITH {_per_pair()} SELECT tile_id, round(mse, 9) AS mse, round(mae, 9) AS mae, round(rmse, 9) AS rmse, round(zncc, 9) AS zncc FROM s""")
def tile_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = metrics.per_tile(model.pairs(spark, sf_dir))
    return scored.select("tile_id", *[F.round(c, 9).alias(c) for c in ("mse", "mae", "rmse", "zncc")])


@query(f"""WITH {_per_pair()} SELECT site, round(10 * log10(1 / avg(mse)), 9) AS psnr FROM s GROUP BY site""")
def batch_psnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model.pairs(spark, sf_dir).select("site", metrics.mse(F.col("t"), F.col("p")).alias("mse"))
    return rows.groupBy("site").agg(F.round(metrics.psnr(F.avg("mse")), 9).alias("psnr"))


@query(f"""WITH {PAIRS} SELECT tile_id, round({_sum('abs(p[i] - t[i]) / abs(p[i] + 1)')} / 64, 9) AS mre FROM pairs""")
def tile_mre(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.pairs(spark, sf_dir).select("tile_id", F.round(metrics.relative(F.col("t"), F.col("p")), 9).alias("mre"))


_MISSING = PAIRS + """, holed AS (SELECT tile_id, list_transform(range(1, 65), lambda i: CASE WHEN (tile_id + i - 1) % 17 = 0 THEN 'nan'::DOUBLE ELSE t[i] * 100 END) AS t, list_transform(p, lambda x: x * 100) AS p FROM pairs)"""


def _holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = F.transform("t", lambda x, i: F.when((F.col("tile_id") + i) % 17 == 0, F.lit(float("nan"))).otherwise(x * 100))
    return model.pairs(spark, sf_dir).select("tile_id", "site", missing.alias("t"), F.transform("p", lambda x: x * 100).alias("p"))


@query(f"""WITH {_MISSING}, z AS (SELECT tile_id, list_transform(range(1, 65), lambda i: CASE WHEN isnan(t[i]) THEN 0 ELSE t[i] END) AS t,
               list_transform(range(1, 65), lambda i: CASE WHEN isnan(t[i]) THEN 0 ELSE p[i] END) AS p FROM holed),
        c AS (SELECT tile_id // 8 AS batch_id, t, list_transform(range(1, 65), lambda i: CASE WHEN t[i] <= 1 THEN 0 WHEN p[i] >= 30 THEN 0 ELSE p[i] END) AS p FROM z),
        e AS (SELECT batch_id, {_sum('(t[i] - p[i]) * (t[i] - p[i])')} AS se, {_sum('abs(t[i] - p[i])')} AS ae FROM c),
        b AS (SELECT batch_id, count(*) AS n, sum(se) / 64 / count(*) AS mse, sum(ae) / 64 / count(*) AS mae FROM e GROUP BY batch_id)
    SELECT sum(n)::BIGINT AS n, round(sum(mse * n) / sum(n), 9) AS mse, round(sum(mae * n) / sum(n), 9) AS mae, round(sqrt(sum(mse * n) / sum(n)), 9) AS rmse FROM b""")
def masked_height_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _holed(spark, sf_dir).select("tile_id", masks.zero_where_missing(F.col("t"), F.col("t")).alias("t"), masks.zero_where_missing(F.col("p"), F.col("t")).alias("p"))
    cut = rows.select("tile_id", "t", masks.thresholded(F.col("t"), F.col("p")).alias("p"))
    return metrics.weighted(metrics.batch_errors(cut, 8))


@query(f"""WITH {_MISSING} SELECT tile_id, len(list_filter(t, lambda x: isnan(x)))::BIGINT AS n_nan, 64 - len(list_filter(t, lambda x: isnan(x)))::BIGINT AS n_valid,
           round({_sum('CASE WHEN isnan(t[i]) THEN 0 ELSE t[i] END')}, 9) AS total FROM holed""")
def nan_mask_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = masks.n_missing(F.col("t"))
    return _holed(spark, sf_dir).select("tile_id", n.alias("n_nan"), (F.size("t") - n).alias("n_valid"), F.round(total(masks.finite(F.col("t"))), 9).alias("total"))


@query(f"""WITH {TILES}, x AS (SELECT site, unnest(v) AS v FROM tiles)
    SELECT site, min(v) AS low, max(v) AS high, round(avg(v), 9) AS mean, round(stddev_pop(v), 9) AS deviation, round(quantile_cont(v, 0.01), 9) AS p1, round(quantile_cont(v, 0.99), 9) AS p99 FROM x GROUP BY site""")
def raster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model.tiles(spark, sf_dir).select("site", F.explode("v").alias("v"))
    plain = [
        F.min("v").alias("low"), F.max("v").alias("high"),
        F.round(F.avg("v"), 9).alias("mean"), F.round(F.stddev_pop("v"), 9).alias("deviation"),
    ]
    out = quantiles(rows, "v", {"p1": 0.01, "p99": 0.99}, "site", also=plain)
    return out.select("site", "low", "high", "mean", "deviation", *[F.round(c, 9).alias(c) for c in ("p1", "p99")])


def _sorted_percentile(q: float) -> Column:
    """Linear interpolation between the sorted values of a tile."""
    place = (F.size("s") - 1) * q
    low = F.floor(place).cast("int")
    a, b = F.get("s", low), F.get("s", F.least(low + 1, F.size("s") - 1))
    return a + (b - a) * (place - low)


@query(f"""WITH {TILES}, q AS (SELECT tile_id, v, list_aggregate(v, 'quantile_cont', 0.01) AS lo, list_aggregate(v, 'quantile_cont', 0.99) AS hi FROM tiles)
    SELECT tile_id, unnest(range(64)) AS i, round(unnest(list_transform(v, lambda x: (least(hi, greatest(lo, x)) - lo) / (hi - lo))), 9) AS v FROM q""")
def percentile_clip_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model.tiles(spark, sf_dir).select("tile_id", "v", F.array_sort("v").alias("s"))
    rows = rows.select("tile_id", "v", _sorted_percentile(0.01).alias("lo"), _sorted_percentile(0.99).alias("hi"))
    return rows.select("tile_id", F.posexplode(transforms.stretch(F.col("v"), F.col("lo"), F.col("hi"))).alias("i", "v")).select("tile_id", F.col("i").cast("long").alias("i"), F.round("v", 9).alias("v"))


def _at(row: str, col: str, a: str = "v") -> str:
    return f"(CASE WHEN {row} BETWEEN 0 AND 7 AND {col} BETWEEN 0 AND 7 THEN {a}[({row}) * 8 + ({col}) + 1] ELSE 0 END)"


def _sobel_sql(a: str, kernel: tuple[tuple[int, ...], ...]) -> str:
    terms = [f"{_at(f'r + {i - 1}', f'c + {j - 1}', a)} * {k}.0" for i, row in enumerate(kernel) for j, k in enumerate(row) if k]
    return " + ".join(f"({t})" for t in terms)


@query(f"""WITH {TILES}, g AS (SELECT tile_id, i, i // 8 AS r, i % 8 AS c, v FROM tiles, range(64) x(i))
    SELECT tile_id, i, {_sobel_sql('v', focal.SOBEL_X)} AS gx, {_sobel_sql('v', focal.SOBEL_Y)} AS gy FROM g""")
def sobel_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    gx, gy = focal.sobel(F.col("v"), _SIDE, _SIDE)
    rows = model.tiles(spark, sf_dir).select("tile_id", F.posexplode(F.arrays_zip(gx.alias("gx"), gy.alias("gy"))).alias("i", "g"))
    return rows.select("tile_id", F.col("i").cast("long").alias("i"), "g.gx", "g.gy")


_GRADIENTS = f"""{PAIRS}, g AS (SELECT tile_id, i, t[i + 1] AS t, p[i + 1] AS p, {_sobel_sql('t', focal.SOBEL_X)} AS a, {_sobel_sql('t', focal.SOBEL_Y)} AS b, {_sobel_sql('p', focal.SOBEL_X)} AS c, {_sobel_sql('p', focal.SOBEL_Y)} AS d
               FROM (SELECT *, i // 8 AS r, i % 8 AS c FROM pairs, range(64) x(i)))"""


@query(f"""WITH {_GRADIENTS} SELECT tile_id, round(avg(ln(abs(t - p) + 0.5)), 9) AS depth, round(avg(ln(abs(a - c) + 0.5)), 9) AS dx, round(avg(ln(abs(b - d) + 0.5)), 9) AS dy,
           round(avg(abs(1 - (a * c + b * d + 1) / (sqrt(a * a + b * b + 1) * sqrt(c * c + d * d + 1)))), 9) AS normal FROM g GROUP BY tile_id""")
def gradient_normal_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = losses.with_gradients(model.pairs(spark, sf_dir), _SIDE, _SIDE)
    dx, dy = losses.gradient_losses()
    parts = {"depth": metrics.log_l1(F.col("t"), F.col("p")), "dx": dx, "dy": dy, "normal": losses.normal_loss()}
    return rows.select("tile_id", *[F.round(v, 9).alias(k) for k, v in parts.items()])


@query(f"""WITH {_GRADIENTS}, m AS (SELECT tile_id, avg(ln(abs(t - p) + 0.5)) + avg(ln(abs(a - c) + 0.5)) + avg(ln(abs(b - d) + 0.5)) + avg(abs(1 - (a * c + b * d + 1) / (sqrt(a * a + b * b + 1) * sqrt(c * c + d * d + 1)))) AS s FROM g GROUP BY tile_id)
    SELECT count(*) AS n, round(avg(s), 9) AS loss FROM m""")
def log_l1_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    dx, dy = losses.gradient_losses()
    rows = losses.with_gradients(model.pairs(spark, sf_dir), _SIDE, _SIDE).select((metrics.log_l1(F.col("t"), F.col("p")) + dx + dy + losses.normal_loss()).alias("s"))
    return rows.agg(F.count("s").alias("n"), F.round(F.avg("s"), 9).alias("loss"))


def _pooled_sql(by: int, n: int) -> str:
    middle = (by // 2 - 1, by // 2)  # the four pixels around the place that a smaller one comes from
    cells = " + ".join(f"(t[(i // {n} * {by} + {a}) * 8 + i % {n} * {by} + {b} + 1])" for a in middle for b in middle)
    return f"({cells}) / 4 - ({cells.replace('t[', 'p[')}) / 4"


def _scale_sql(by: int) -> str:
    n = 8 // by
    return f"(SELECT avg(pow({_pooled_sql(by, n)}, 2)) FROM range({n * n}) x(i))"


@query(f"""WITH {PAIRS} SELECT tile_id, round((SELECT avg(pow(t[i + 1] - p[i + 1], 2)) FROM range(64) x(i)) + 2 * {_scale_sql(2)} + 3 * {_scale_sql(4)}, 9) AS loss FROM pairs""")
def multiscale_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.pairs(spark, sf_dir).select("tile_id", F.round(losses.multiscale(F.col("t"), F.col("p"), _SIDE, _SIDE), 9).alias("loss"))


@query(f"""WITH {TILES}, x AS (SELECT tile_id, (i // 8) // 4 AS r, (i % 8) // 4 AS c, v[i + 1] AS v FROM tiles, range(64) x(i))
    SELECT tile_id, r, c, round(avg(v), 9) AS mean, max(v) AS high FROM x GROUP BY tile_id, r, c""")
def block_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.arrays_zip(focal.pool(F.col("v"), 4, _SIDE, _SIDE).alias("mean"), focal.pool(F.col("v"), 4, _SIDE, _SIDE, "max").alias("high"))
    rows = model.tiles(spark, sf_dir).select("tile_id", F.posexplode(both).alias("i", "x"))
    return rows.select("tile_id", F.floor(F.col("i") / 2).cast("long").alias("r"), F.pmod("i", F.lit(2)).cast("long").alias("c"), F.round("x.mean", 9).alias("mean"), F.col("x.high").alias("high"))


@query(f"""WITH {PAIRS} SELECT tile_id, round({_sum('abs(t[i] - p[i])')} / 64, 9) AS recon, round({_sum('t[i] * t[i]')} / 64, 9) AS kl, round({_sum('(p[i] - 1) * (p[i] - 1)')} / 64, 9) AS ls_real, round({_sum('p[i] * p[i]')} / 64, 9) AS ls_fake,
           round({_sum('greatest(p[i], 0) - p[i] + ln(1 + exp(-abs(p[i])))')} / 64, 9) AS ns_real,
           round({_sum('(p[i] - 1) * (p[i] - 1)')} / 64 + 20 * {_sum('abs(t[i] - p[i])')} / 64 + 0.01 * {_sum('t[i] * t[i]')} / 64 + 0.01 * {_sum('p[i] * p[i]')} / 64, 9) AS total FROM pairs""")
def gan_vae_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, p = F.col("t"), F.col("p")
    parts = {"recon": losses.l1(t, p), "kl": losses.square(t), "ls_real": losses.least_squares_gan(p, 1.0), "ls_fake": losses.least_squares_gan(p, 0.0), "ns_real": losses.cross_entropy_gan(p, 1.0), "total": losses.translation_total(t, p, t)}
    return model.pairs(spark, sf_dir).select("tile_id", *[F.round(v, 9).alias(k) for k, v in parts.items()])


@query("""SELECT quality AS y_true, toxic AS y_pred, count(*) AS n FROM labels GROUP BY ALL""")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.confusion(model.class_pixels(spark, sf_dir))


_CLASSES = """c AS (SELECT quality AS class FROM labels UNION SELECT toxic FROM labels),
    m AS (SELECT class, (SELECT count(*) FROM labels WHERE quality = class) AS support, (SELECT count(*) FROM labels WHERE toxic = class) AS predicted, (SELECT count(*) FROM labels WHERE quality = class AND toxic = class) AS hits FROM c),
    r AS (SELECT class, support, predicted, coalesce(hits / nullif(predicted, 0), 0)::DOUBLE AS precision, coalesce(hits / nullif(support, 0), 0)::DOUBLE AS recall FROM m)"""


@query(f"""WITH {_CLASSES} SELECT class, support, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM r""")
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.report(model.class_pixels(spark, sf_dir))


@query(f"""WITH {_CLASSES}, k AS (SELECT (SELECT count(*) FROM labels)::DOUBLE AS n, (SELECT count(*) FROM labels WHERE quality = toxic) AS hits, (SELECT sum(support * predicted) FROM r) AS products, (SELECT avg(recall) FROM r) AS aa)
    SELECT n::BIGINT AS n, hits / n AS oa, aa, coalesce((hits / n - products / (n * n)) / nullif(1 - products / (n * n), 0), 0) AS kappa FROM k""")
def oa_aa_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.agreement(model.class_pixels(spark, sf_dir))


@query(f"""WITH {PAIRS} SELECT tile_id, round({_sum('t[i] * t[i]')}, 9) AS squares, round(sqrt({_sum('t[i] * t[i]')}), 9) AS length,
           round(exp(t[1] - list_max(t)) / {_sum('exp(t[i] - list_max(t))')}, 9) AS first_softmax, greatest(t[1], p[1]) AS larger FROM pairs""")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    return model.pairs(spark, sf_dir).select("tile_id", F.round(total(F.transform(t, lambda x: x * x)), 9).alias("squares"), F.round(transforms.length(t), 9).alias("length"), F.round(F.get(transforms.softmax(t), F.lit(0)), 9).alias("first_softmax"), F.greatest(F.get("t", F.lit(0)), F.get("p", F.lit(0))).alias("larger"))


def _ssim_sql(window: int, by: int) -> str:
    """Over tiles enlarged by times."""
    n, places = window * window, 8 * by - window + 1
    at = f"((kr + i // {window}) // {by}) * 8 + (kc + i % {window}) // {by} + 1"
    fix = f"({n} / {n - 1}::DOUBLE)"
    return f"""WITH {PAIRS}, x AS (SELECT tile_id, kr, kc, t[{at}] AS x, p[{at}] AS y
                 FROM pairs, range({places}) a(kr), range({places}) b(kc), range({n}) c(i)),
        w AS (SELECT tile_id, kr, kc, avg(x) AS ux, avg(y) AS uy, avg(x * x) AS xx, avg(y * y) AS yy, avg(x * y) AS xy
              FROM x GROUP BY tile_id, kr, kc),
        s AS (SELECT tile_id, (2 * ux * uy + 1e-4) * (2 * {fix} * (xy - ux * uy) + 9e-4)
                     / ((ux * ux + uy * uy + 1e-4) * ({fix} * (xx - ux * ux) + {fix} * (yy - uy * uy) + 9e-4)) AS s FROM w)
        SELECT tile_id, round(avg(s), 9) AS ssim FROM s GROUP BY tile_id"""


@query(_ssim_sql(7, 1))
def ssim_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = metrics.ssim(F.col("t"), F.col("p"), _SIDE, _SIDE)
    return model.pairs(spark, sf_dir).select("tile_id", F.round(score, 9).alias("ssim"))


@query(_ssim_sql(15, 2))
def ssim_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a window of 15, over tiles of twice the size."""
    big = [focal.enlarge(F.col(c), 2, _SIDE, _SIDE).alias(c) for c in ("t", "p")]
    score = metrics.ssim(F.col("t"), F.col("p"), 2 * _SIDE, 2 * _SIDE, 15)
    return model.pairs(spark, sf_dir).select("tile_id", *big).select("tile_id", F.round(score, 9).alias("ssim"))


@query(f"""WITH {PAIRS}, m AS (SELECT *, {_sum('t[i]')} / 64 AS mt, {_sum('p[i]')} / 64 AS mp FROM pairs),
    d AS (SELECT *, sqrt({_sum('(t[i] - mt) * (t[i] - mt)')} / 64 + 1e-5) AS dt,
                 sqrt({_sum('(p[i] - mp) * (p[i] - mp)')} / 64 + 1e-5) AS dp FROM m),
    x AS (SELECT tile_id, {_sum('(p[i] - 1) * (p[i] - 1) + (t[i] - 1) * (t[i] - 1)')} / 64 AS adversarial,
                 2 * {_sum('abs(t[i] - p[i])')} / 64 AS recon, {_sum('t[i] * t[i] + p[i] * p[i]')} / 64 AS code,
                 2 * {_sum('pow((t[i] - mt) / dt - (p[i] - mp) / dp, 2)')} / 64 AS perceptual FROM d)
    SELECT tile_id, round(adversarial, 9) AS adversarial, round(recon, 9) AS recon, round(code, 9) AS code,
           round(perceptual, 9) AS perceptual, round(adversarial + 20 * recon + 0.02 * code + perceptual, 9) AS total FROM x""")
def translation_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve terms, six a direction; a tile and the next one stand in for images, codes and features."""
    t, p = F.col("t"), F.col("p")
    terms = [losses.translation_terms(x, y, y, x, y, y, x, y) for x, y in ((t, p), (p, t))]
    both = {name: terms[0][name] + terms[1][name] for name in terms[0]}
    total_ = losses.weighted_total(terms, {**losses.WEIGHTS, "vgg": 1.0})
    shown = {"adversarial": "gan", "recon": "recon_x", "code": "recon_kl", "perceptual": "vgg"}
    cols = [F.round(both[term], 9).alias(name) for name, term in shown.items()]
    return model.pairs(spark, sf_dir).select("tile_id", *cols, F.round(total_, 9).alias("total"))


@query(f"""WITH {PAIRS}, x AS (SELECT tile_id, unnest(list_transform(range(1, 65), lambda i: abs(t[i] - p[i]))) AS d FROM pairs) SELECT tile_id, max(d) AS worst, count(*) FILTER (WHERE d > 0.25) AS n_off FROM x GROUP BY tile_id""")
def pixel_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = paired(F.col("t"), F.col("p"), lambda x, y: F.abs(x - y))
    return model.pairs(spark, sf_dir).select("tile_id", F.array_max(off).alias("worst"), F.size(F.filter(off, lambda d: d > 0.25)).cast("long").alias("n_off"))
