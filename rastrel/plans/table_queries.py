"""Catalogues, pairing, sampling, names and training logs over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions import names
from ..operators import augment, catalog, losses, pairing, runlog, sampling
from ..sources import sinks
from .registry import RUNLOG, SCENES, TILES, fractal, query

_CHOSEN = f"""{SCENES}, m AS (SELECT *, acq_date >= DATE '2024-01-05' AND acq_date < DATE '2024-01-08' AND cloud_pct < 2 AS fits FROM scenes),
    chosen AS (SELECT * FROM (SELECT *, sum(fits::INTEGER) OVER (PARTITION BY region) AS n FROM m) WHERE fits OR n = 0)"""


def _chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.chosen(model.scenes(spark, sf_dir), "2024-01-05", "2024-01-08", 2.0)


@query(f"WITH {_CHOSEN} SELECT scene_id, region, acq_date, fits FROM chosen")
def scene_filter_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chosen(spark, sf_dir).select("scene_id", "region", "acq_date", "fits")


@query(f"WITH {_CHOSEN} SELECT region, band, count(*) AS n_obs, median(v) AS v FROM chosen GROUP BY region, band")
def median_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.composite(_chosen(spark, sf_dir), "region", "band")


@query("""SELECT l_suppkey AS place, l_linestatus AS band, count(*) AS n_obs, median(l_extendedprice) AS v FROM lineitem GROUP BY ALL""")
def observation_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("place"), F.col("l_linestatus").alias("band"), F.col("l_extendedprice").alias("v"))
    return catalog.composite(rows, "place", "band")


@query(f"""WITH {_CHOSEN}, c AS (SELECT region, band, median(v) AS v FROM chosen GROUP BY region, band), p AS (SELECT region, max(v) FILTER (WHERE band = 'click') AS red, max(v) FILTER (WHERE band = 'view') AS green, max(v) FILTER (WHERE band = 'purchase') AS blue FROM c GROUP BY region)
    SELECT region, red, green, blue, coalesce(greatest(red, green, blue) > 255, false) AS bright, floor(least(1.0::DOUBLE, greatest(0.0::DOUBLE, CASE WHEN greatest(red, green, blue) > 255 THEN red / 490.0::DOUBLE ELSE red / 255.0::DOUBLE END)) * 255)::INTEGER AS red_u8 FROM p""")
def rgb_band_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = catalog.composite(_chosen(spark, sf_dir), "region", "band")
    wide = bands.groupBy("region").pivot("band", ["click", "view", "purchase"]).agg(F.max("v")).toDF("region", "red", "green", "blue")
    top = F.greatest("red", "green", "blue")
    scaled = F.when(top > 255, F.col("red") / 490.0).otherwise(F.col("red") / 255.0)
    return wide.select("*", F.coalesce(top > 255, F.lit(False)).alias("bright"), F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), scaled)) * 255).cast("int").alias("red_u8"))


_MEET = """r AS (SELECT s_suppkey AS region_id, (s_suppkey * 37 % 900)::DOUBLE AS xmin, (s_suppkey * 91 % 700)::DOUBLE AS ymin, (s_suppkey * 37 % 900)::DOUBLE + 25 AS xmax, (s_suppkey * 91 % 700)::DOUBLE + 18 AS ymax FROM supplier),
    s AS (SELECT c_custkey AS scene_id, (c_custkey * 53 % 890)::DOUBLE AS xmin, (c_custkey * 71 % 690)::DOUBLE AS ymin, (c_custkey * 53 % 890)::DOUBLE + 30 AS xmax, (c_custkey * 71 % 690)::DOUBLE + 30 AS ymax FROM customer)"""


@query(f"WITH {_MEET} SELECT region_id, scene_id FROM r JOIN s ON r.xmin <= s.xmax AND s.xmin <= r.xmax AND r.ymin <= s.ymax AND s.ymin <= r.ymax")
def scene_intersects(spark: SparkSession, sf_dir: str) -> DataFrame:
    def boxes(name: str, key: str, out: str, a: int, m: int, b: int, n: int, w: int, h: int) -> DataFrame:
        x, y = F.pmod(F.col(key) * a, F.lit(m)).cast("double"), F.pmod(F.col(key) * b, F.lit(n)).cast("double")
        return model.table(spark, sf_dir, name).select(F.col(key).alias(out), x.alias("xmin"), y.alias("ymin"), (x + w).alias("xmax"), (y + h).alias("ymax"))

    return catalog.meeting(boxes("supplier", "s_suppkey", "region_id", 37, 900, 91, 700, 25, 18), boxes("customer", "c_custkey", "scene_id", 53, 890, 71, 690, 30, 30), 32.0)


@query("""SELECT 'tile_' || o_orderkey AS name FROM orders WHERE NOT (o_orderstatus = 'O' AND o_orderpriority LIKE '1%')""")
def skip_existing_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = model.table(spark, sf_dir, "orders").select(F.format_string("tile_%d", "o_orderkey").alias("name"), "o_orderstatus", "o_orderpriority")
    images = orders.where("o_orderstatus = 'O'").select("name", F.lit("jpg").alias("kind"))
    return catalog.pending(orders.select("name"), images.union(orders.where("o_orderpriority like '1%'").select("name", F.lit("tif").alias("kind"))), ("jpg", "tif"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'missing' ELSE 'paired' END AS state FROM orders""")
def pair_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels dsm<id>.tif and images image<id>.tif joined on the id in their names."""
    orders = model.table(spark, sf_dir, "orders")
    labels = orders.select(F.format_string("dsm%d.tif", "o_orderkey").alias("path"))
    images = orders.where("o_orderstatus <> 'P'").select(F.format_string("image%d.tif", "o_orderkey").alias("path"))
    by_name = lambda rows, prefix: rows.select(F.substring(names.stem(F.col("path")), len(prefix) + 1, 20).cast("long").alias("id"))
    paired, missing = pairing.by_id(by_name(labels, "dsm"), by_name(images, "image"), "id")
    return paired.select("id", F.lit("paired").alias("state")).union(missing.select("id", F.lit("missing").alias("state")))


@query("""WITH a AS (SELECT p_name AS a, p_brand AS bucket, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS rn FROM part), b AS (SELECT p_partkey AS b, p_brand AS bucket, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS rn FROM part WHERE p_size > 10)
    SELECT bucket, rn, a, b FROM a JOIN b USING (bucket, rn)""")
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = model.table(spark, sf_dir, "part").withColumn("bucket", F.col("p_brand"))
    a, b = part.select("bucket", F.col("p_name").alias("a"), "p_partkey"), part.where("p_size > 10").select("bucket", F.col("p_partkey").alias("b"), "p_retailprice")
    return pairing.zipped(a, [F.col("a"), F.col("p_partkey")], b, [F.col("p_retailprice"), F.col("b")], "bucket").select("bucket", "rn", "a", "b")


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN 255 ELSE 0 END AS red, CASE WHEN l_discount > 0.04 THEN 255 ELSE 0 END AS green, CASE WHEN l_tax > 0.03 THEN 255 ELSE 0 END AS blue FROM lineitem),
    c AS (SELECT *, coalesce(list_position([(255, 255, 255), (0, 0, 255), (0, 255, 255), (0, 255, 0), (255, 255, 0), (255, 0, 0)], (red, green, blue)) - 1, 0)::INTEGER AS class_id FROM p) SELECT class_id, count(*) AS n, sum(l_linenumber)::BIGINT AS lines FROM c GROUP BY class_id""")
def palette_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    on = lambda c: F.when(c, 255).otherwise(0)
    rows = model.table(spark, sf_dir, "lineitem").select("l_linenumber", on(F.col("l_quantity") > 25).alias("red"), on(F.col("l_discount") > 0.04).alias("green"), on(F.col("l_tax") > 0.03).alias("blue"))
    return pairing.palette_ids(rows).groupBy("class_id").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("lines"))


@query(f"WITH {TILES} SELECT a.tile_id, round(list_sum(list_concat(a.v, b.v)), 9) AS total, len(list_concat(a.v, b.v)) AS n FROM tiles a JOIN tiles b ON b.tile_id = a.tile_id + 1")
def feature_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.arrays import total

    both = pairing.stacked(F.col("t"), F.col("p"))
    return model.pairs(spark, sf_dir).select("tile_id", F.round(total(both), 9).alias("total"), F.size(both).cast("long").alias("n"))


@query("""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('split|' || o_orderkey), o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders)
    SELECT o_orderkey, CASE WHEN k < n // 10 * 7 THEN 'train' WHEN k < floor(n / 10 * 7) THEN 'train' WHEN k < floor(n / 10 * 7) + floor(n / 10 * 1) THEN 'validation' WHEN k < floor(n / 10 * 7) + floor(n / 10 * 1) + floor(n / 10 * 2) THEN 'test' ELSE 'rest' END AS split FROM r""")
def split_70_10_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.split(model.table(spark, sf_dir, "orders"), "split", "o_orderkey")


@query("""WITH r AS (SELECT p_partkey, p_brand, k.k AS repeat, row_number() OVER (PARTITION BY k.k, p_brand ORDER BY md5('69-' || k.k || '|' || p_partkey), p_partkey) AS rank,
                       count(*) OVER (PARTITION BY k.k, p_brand) AS n FROM part, range(10) k(k))
    SELECT p_partkey, p_brand, repeat, CASE WHEN rank <= greatest(1, floor(n * 0.05::DOUBLE)) THEN 'train' ELSE 'test' END AS split FROM r""")
def stratified_split_5_95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ten repeats, each with a seed of its own."""
    parts = model.table(spark, sf_dir, "part")
    return sampling.stratified(parts, 69, "p_partkey", "p_brand", 0.05, 10)


@query("""WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY md5('69-0|' || p_partkey), p_partkey) AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
    t AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY md5('7-0|' || p_partkey), p_partkey) AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM r WHERE k > greatest(1, floor(n * 0.05::DOUBLE)))
    SELECT p_brand, CASE WHEN k <= greatest(1, floor(n * 0.05::DOUBLE)) THEN 'train' ELSE 'test' END AS split, count(*) AS n FROM t GROUP BY ALL""")
def nested_validation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = sampling.stratified(model.table(spark, sf_dir, "part"), 69, "p_partkey", "p_brand", 0.05).where("split = 'test'").drop("split")
    return sampling.stratified(rest, 7, "p_partkey", "p_brand", 0.05).groupBy("p_brand", "split").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS id FROM lineitem), s AS (SELECT id, row_number() OVER (ORDER BY md5('epoch-1|' || id), id) - 1 AS k, count(*) OVER () AS n FROM r)
    SELECT id, k // 64 AS batch_id FROM s WHERE (k // 64 + 1) * 64 <= n""")
def hash_shuffle_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return sampling.batches(rows, "epoch-1", 64, "id")


@query("""SELECT p_name AS name, t AS trial, ('0x' || substr(md5('0|' || p_name || '|' || t), 1, 8))::BIGINT AS seed FROM part, range(1, 4) x(t)""")
def trial_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.trial_seeds(model.table(spark, sf_dir, "part").select(F.col("p_name").alias("name")), 3)


@query("""WITH u AS (SELECT vec_id AS tile_id, ('0x' || substr(md5('cropr|' || vec_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS r, ('0x' || substr(md5('cropc|' || vec_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS c, ('0x' || substr(md5('cropf|' || vec_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS f FROM embeddings)
    SELECT tile_id, floor(r * 257)::BIGINT AS row0, floor(c * 257)::BIGINT AS col0, f < 0.5 AS flip FROM u""")
def random_crop_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    row, col, flip = sampling.random_window("crop", F.col("tile_id"), 512, 512, 256)
    return model.tiles(spark, sf_dir).select("tile_id", row.alias("row0"), col.alias("col0"), flip.alias("flip"))


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 16")
def display_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.table(spark, sf_dir, "part").select("p_partkey", "p_name").orderBy("p_partkey").limit(16)


_FILES = "f AS (SELECT 'area/top_mosaic_09cm_slice_' || p_partkey || '.tif' AS path, p_partkey, p_brand, p_size FROM part)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.table(spark, sf_dir, "part").select(F.concat(F.lit("area/top_mosaic_09cm_slice_"), F.col("p_partkey"), F.lit(".tif")).alias("path"), "p_partkey", "p_brand", "p_size")


@query(f"WITH {_FILES} SELECT path, 'image' || CASE WHEN p_partkey >= 1000 THEN p_partkey::VARCHAR ELSE lpad(p_partkey::VARCHAR, 4, '0') END || '.tif' AS new_name, 'top_mosaic_09cm_slice_' || p_partkey AS stem FROM f")
def rename_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return _files(spark, sf_dir).select("path", names.slice_name(path, "image").alias("new_name"), names.stem(path).alias("stem"))


@query(f"WITH {_FILES} SELECT path, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS place FROM f")
def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _files(spark, sf_dir).withColumn("key", names.natural_key(F.col("path")))
    return pairing.numbered(rows, [F.col("key")], "place", "p_brand").select("path", "place")


@query("""WITH f AS (SELECT p_partkey, p_brand || '/' || p_partkey || '.png' AS path FROM part) SELECT path, split_part(path, '/', 1) AS label, dense_rank() OVER (ORDER BY split_part(path, '/', 1)) - 1 AS class_id FROM f""")
def path_label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels are few; only they are numbered in one task, and go to the files' tasks."""
    from pyspark.sql import Window

    rows = model.table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("/"), F.col("p_partkey"), F.lit(".png")).alias("path")).withColumn("label", names.class_label(F.col("path")))
    labels = rows.select("label").distinct().withColumn("class_id", (F.row_number().over(Window.orderBy("label")) - 1).cast("long"))
    return rows.join(labels, "label").select("path", "label", "class_id")


_CHECKPOINTS = "c AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'gen' ELSE 'dis' END || '_' || format('{:08d}', o_orderkey) || '.pt' AS name, o_orderkey FROM orders UNION ALL SELECT 'gen_latest.pt', 0)"


@query(f"WITH {_CHECKPOINTS} SELECT substr(name, 1, 3) AS kind, arg_max(name, o_orderkey) AS name FROM c WHERE name NOT LIKE '%latest%' GROUP BY 1")
def checkpoint_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("o_orderkey") % 2 == 0, "gen").otherwise("dis")
    files = model.table(spark, sf_dir, "orders").select(F.concat(kind, F.lit("_"), F.format_string("%08d", "o_orderkey"), F.lit(".pt")).alias("name"))
    files = files.union(spark.createDataFrame([("gen_latest.pt",)], "name string"))
    return runlog.latest(files, F.substring("name", 1, 3), names.iteration(F.col("name")))


@query("""WITH f AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'a/.hidden' || page_id || '.tif' WHEN 1 THEN 'a/x_tile_' || page_id || '.TIF' WHEN 2 THEN 'a/b' || page_id || '.tiff' WHEN 3 THEN 'a/p' || page_id || '.JPG' ELSE 'a/n' END AS path FROM pages)
    SELECT page_id, path, page_id % 5 IN (0, 1, 2) AS tiff, page_id % 5 = 3 AS image, page_id % 5 = 0 AS hidden, page_id % 5 = 1 AS tile, page_id % 5 <> 4 AS long_name FROM f""")
def suffix_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.pmod("page_id", F.lit(5))
    named = lambda a, b: F.concat(F.lit(a), F.col("page_id"), F.lit(b))
    path = F.when(k == 0, named("a/.hidden", ".tif")).when(k == 1, named("a/x_tile_", ".TIF")).when(k == 2, named("a/b", ".tiff")).when(k == 3, named("a/p", ".JPG")).otherwise("a/n")
    rows, path = model.table(spark, sf_dir, "pages").select("page_id", path.alias("path")), F.col("path")
    return rows.select("page_id", "path", names.is_tiff(path).alias("tiff"), names.is_image(path).alias("image"), names.hidden(path).alias("hidden"), F.lower(path).rlike(r"_tile_.*\.tif$").alias("tile"), (F.length(names.base_name(path)) > 5).alias("long_name"))


@query("""SELECT event_id, format('{:.3e}', 0.0::DOUBLE) AS zero, format('{:04d}', event_id) AS padded, replace(replace(replace(format('{:.3e}', value / 7), 'e+0', 'e+'), 'e-0', 'e-'), 'e+', 'e+') AS text FROM events""")
def formatted_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.table(spark, sf_dir, "events").select("event_id", F.format_string("%.3e", F.lit(0.0)).alias("zero"), F.format_string("%04d", "event_id").alias("padded"), names.compact_exponent(F.col("value") / 7).alias("text"))


@query("""WITH f AS (SELECT event_id, user_id, value, CASE event_id % 4 WHEN 0 THEN 'potsdam_' WHEN 1 THEN 'vaihingen_' WHEN 2 THEN 'sweden_' ELSE 'potsdam_sweden_' END || event_id AS name FROM events),
    s AS (SELECT f.*, site FROM f, (VALUES ('potsdam'), ('vaihingen'), ('sweden')) x(site) WHERE contains(name, site)),
    g AS (SELECT site, count(*) AS n, avg(value / 10) AS rmse, stddev_samp(value / 10) AS deviation FROM s GROUP BY site) SELECT site, n, round(rmse, 9) AS rmse, round(deviation, 9) AS deviation FROM g""")
def site_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file counts for every site whose name is in its own."""
    k = F.pmod("event_id", F.lit(4))
    prefix = F.when(k == 0, "potsdam_").when(k == 1, "vaihingen_").when(k == 2, "sweden_").otherwise("potsdam_sweden_")
    rows = model.table(spark, sf_dir, "events").select(F.concat(prefix, F.col("event_id").cast("string")).alias("name"), "value")
    sites = F.filter(F.array(*[F.lit(s) for s in ("potsdam", "vaihingen", "sweden")]), lambda s: F.contains(F.col("name"), s))
    grouped = rows.select(F.explode(sites).alias("site"), (F.col("value") / 10).alias("v")).groupBy("site")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 9).alias("rmse"), F.round(F.stddev_samp("v"), 9).alias("deviation"))


@query(f"""WITH {RUNLOG} SELECT metric, epoch, iter, sum(value::DECIMAL(18, 2) * n) OVER w::DOUBLE AS total, (sum(n) OVER w)::BIGINT AS count, sum(value::DECIMAL(18, 2) * n) OVER w::DOUBLE / (sum(n) OVER w)::BIGINT AS mean
    FROM runlog WINDOW w AS (PARTITION BY metric, epoch ORDER BY iter ROWS UNBOUNDED PRECEDING)""")
def running_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.running_mean(model.runlog(spark, sf_dir), "metric", "epoch")


@query(f"WITH {RUNLOG} SELECT epoch, metric, count(*) AS n, sum(value::DECIMAL(18, 2))::DOUBLE / count(*) AS mean FROM runlog GROUP BY ALL")
def epoch_metric_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.epoch_means(model.runlog(spark, sf_dir))


@query("""SELECT event_id AS step, round(0.0001::DOUBLE * pow(0.9::DOUBLE, floor(event_id / 500)), 15) AS by_epoch, 0.0001::DOUBLE * pow(0.5::DOUBLE, event_id // 1000) AS by_step FROM events""")
def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), F.round(losses.rate_by_epoch(1e-4, F.col("event_id"), 500), 15).alias("by_epoch"), losses.rate_by_step(1e-4, F.col("event_id"), 1000, 0.5).alias("by_step"))


@query("SELECT event_id AS iter, event_id % 200 = 0 AS dumped, (event_id + 1) % 1000 = 0 AS saved FROM events WHERE (event_id + 1) % 10 = 0 OR event_id % 200 = 0")
def periodic_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return model.table(spark, sf_dir, "events").where(runlog.due(k, 10, 1) | runlog.due(k, 200)).select(k.alias("iter"), runlog.due(k, 200).alias("dumped"), runlog.due(k, 1000, 1).alias("saved"))


@query("""WITH w AS (SELECT event_id AS iter, value AS loss_total, value * 2 AS grad_norm FROM events) SELECT iter, 'loss_total' AS metric, loss_total AS value FROM w UNION ALL SELECT iter, 'grad_norm', grad_norm FROM w""")
def metric_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = model.table(spark, sf_dir, "events").select(F.col("event_id").alias("iter"), F.col("value").alias("loss_total"), (F.col("value") * 2).alias("grad_norm"), F.col("user_id").alias("batch"))
    return runlog.long_metrics(wide, "iter")


@query("SELECT event_id AS iter, 'iteration [' || event_id || ']' AS text FROM events WHERE event_id > 0 AND event_id % 500 = 0")
def html_report_iterations(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = model.table(spark, sf_dir, "events").select(F.col("event_id").alias("iter"))
    return runlog.report_rows(log, 500).orderBy(F.desc("iter"))


@query("""WITH f AS (SELECT p_name AS name, p_partkey, p_partkey * 123457 + 1 AS size FROM part) SELECT name, k AS part, k * 70000000 AS start, least(70000000, size - k * 70000000) AS size FROM (SELECT *, unnest(range(greatest(1, ceil(size / 70000000)::BIGINT))) AS k FROM f)""")
def file_part_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.parts(model.table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), (F.col("p_partkey") * 123457 + 1).alias("size")))


@query("""SELECT page_id AS name, greatest(1, ceil(octet_length(encode(coalesce(html, ''))) / 1000))::INTEGER AS n_parts, sha256(coalesce(html, '')) AS digest FROM pages""")
def byte_parts_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages cut into parts of 1000 bytes and put together again from parts in another order."""
    files = model.table(spark, sf_dir, "pages").select(F.col("page_id").alias("name"), F.encode("html", "UTF-8").alias("content"))
    parts = sinks.split_bytes(files, 1000).repartition(F.hash("part", "name"))
    return sinks.rejoined(parts).select("name", "n_parts", F.sha2("content", 256).alias("digest"))


@query("""SELECT event_id, '{"seed":' || user_id || ',"kind":"' || event_type || '"}' AS log, user_id AS seed, (props->>'k')::BIGINT AS k FROM events""")
def json_log_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = F.to_json(F.struct(F.col("user_id").alias("seed"), F.col("event_type").alias("kind")))
    return model.table(spark, sf_dir, "events").select("event_id", log.alias("log"), "props").select("event_id", "log", F.from_json("log", "seed long, kind string")["seed"].alias("seed"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""SELECT count(*) FILTER (WHERE l_returnflag = 'N' AND l_discount > 0) AS n_ok, count(*) FILTER (WHERE l_returnflag <> 'N') AS n_skipped, count(*) FILTER (WHERE l_returnflag = 'N' AND l_discount = 0) AS n_failed FROM lineitem""")
def status_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row fails alone: what would raise gives null, and null counts as failed."""
    tried = F.try_divide(F.col("l_extendedprice"), F.col("l_discount"))
    rows = model.table(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") != "N", "skipped").when(tried.isNull(), "failed").otherwise("ok").alias("status"))
    return catalog.tallies(rows)


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'blur' WHEN 'view' THEN 'cloud' ELSE 'quality' END AS kind, user_id::VARCHAR AS seed FROM events""")
def augmentation_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = F.map_concat(F.create_map(F.lit("kind"), F.col("event_type")), F.create_map(F.lit("seed"), F.col("user_id").cast("string")))
    kind = F.when(F.col("event_type") == "click", "blur").when(F.col("event_type") == "view", "cloud").when(F.col("event_type").isNotNull(), "quality").otherwise(F.raise_error(F.lit("no such augmentation")))
    return model.table(spark, sf_dir, "events").select("event_id", kind.alias("kind"), F.element_at(merged, "seed").alias("seed"))


@query("""WITH l AS (SELECT event_type AS metric, event_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts, event_id)) AS us FROM events) SELECT metric, event_id, us FROM l WHERE us IS NOT NULL""")
def elapsed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = model.table(spark, sf_dir, "events")
    return runlog.elapsed(events.select(F.col("event_type").alias("metric"), "event_id", F.col("ts").cast("timestamp").alias("ts")), "metric", "ts", "event_id")


@query("""WITH k AS (SELECT p_partkey, map {'conv.weight': 1, 'conv.running_mean': 2, 'conv.running_var': 3, 'conv.bias': p_size} AS m FROM part) SELECT p_partkey, len(list_filter(map_keys(m), lambda x: NOT x LIKE '%running_mean' AND NOT x LIKE '%running_var')) AS n_kept FROM k""")
def state_key_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.create_map(F.lit("conv.weight"), F.lit(1), F.lit("conv.running_mean"), F.lit(2), F.lit("conv.running_var"), F.lit(3), F.lit("conv.bias"), F.col("p_size"))
    kept = F.map_filter(state, lambda k, v: ~(k.endswith("running_mean") | k.endswith("running_var")))
    return model.table(spark, sf_dir, "part").select("p_partkey", F.size(kept).cast("long").alias("n_kept"))


@query("""WITH o AS (SELECT vec_id AS tile_id, list_transform(list_sort(list_transform(['brightness', 'contrast', 'saturation'], lambda n: md5('jitter|' || vec_id || '|' || n) || ' ' || n)), lambda x: split_part(x, ' ', 2)) AS o FROM embeddings) SELECT tile_id, array_to_string(o, ',') AS steps FROM o""")
def jitter_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which a tile's colour steps are applied."""
    return model.tiles(spark, sf_dir).select("tile_id", F.array_join(sampling.shuffled_steps("jitter", ("brightness", "contrast", "saturation"), F.col("tile_id")), ",").alias("steps"))


@query("""WITH b AS (SELECT p_partkey, range(p_size % 6 + 1) AS bands FROM part) SELECT p_partkey, CASE WHEN len(bands) IN (3, 4) THEN 3 ELSE 1 END::BIGINT AS n_bands, list_sum(CASE WHEN len(bands) IN (3, 4) THEN bands[1:3] ELSE bands[1:1] END)::BIGINT AS total FROM b""")
def band_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.grid import band_subset as subset

    rows = model.table(spark, sf_dir, "part").select("p_partkey", F.sequence(F.lit(0), F.pmod("p_size", F.lit(6))).alias("bands")).select("p_partkey", subset(F.col("bands")).alias("kept"))
    return rows.select("p_partkey", F.size("kept").cast("long").alias("n_bands"), F.aggregate("kept", F.lit(0).cast("long"), lambda a, b: a + b).alias("total"))


@query("""SELECT p_brand AS label, count(*) AS n FROM part GROUP BY 1""")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id AS tile_id, CASE WHEN toxic = 0 THEN 0 ELSE quality END AS truth, CASE WHEN toxic = 0 THEN 0 ELSE quality END - 1 AS label FROM embeddings JOIN labels ON doc_id = vec_id WHERE NOT (CASE WHEN toxic = 0 THEN 0 ELSE quality END = 0)")
def labelled_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels whose class is known after those without a prediction are cleared; label counts the classes from 0."""
    from ..operators.masks import labelled_only

    pixels = model.class_pixels(spark, sf_dir).withColumnRenamed("px_id", "tile_id")
    rows = model.tiles(spark, sf_dir).select("tile_id").join(pixels, "tile_id")
    return rows.select("tile_id", labelled_only(F.col("y_true"), F.col("y_pred")).alias("truth")).where("truth <> 0").withColumn("label", F.col("truth") - 1)


@query()
def forest_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extra: a random forest of 100 trees on the tiles' pixels, trained on the stratified 5 per cent."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    tiles = model.tiles(spark, sf_dir).select("tile_id", "site", array_to_vector("v").alias("features"))
    split = sampling.stratified(tiles, 69, "tile_id", "site", 0.05).select("tile_id", "split")
    both = tiles.join(split, "tile_id")
    model_ = RandomForestClassifier(labelCol="site", numTrees=100, maxDepth=5, seed=69).fit(both.where("split = 'train'"))
    return model_.transform(both.where("split = 'test'")).select("tile_id", "site", F.col("prediction").cast("int").alias("y_pred"))


@query(f"WITH {fractal(3.0)} SELECT tile_id, i, round(f[i + 1], 9) AS v FROM fractal, range(64) x(i)")
def plasma_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fractal for each tile, from its number."""
    maps = augment.per_batch(model.tiles(spark, sf_dir), lambda ids, _: augment.plasma(8, 3.0, augment.draws(ids, 64)), 8, 8)
    flat = maps.select("tile_id", F.posexplode("v").alias("i", "v"))
    return flat.select("tile_id", F.col("i").cast("long").alias("i"), F.round("v", 9).alias("v"))
