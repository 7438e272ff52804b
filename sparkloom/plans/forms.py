"""Queries on small forms: texts, boxes, arrays, turns, losses by name, and files written and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, geometry, text
from ..operators import annotations as an
from ..operators import losses, masks, metrics, registry, trajectory
from ..sources import readers, volumes, writers
from ..streaming.executor import shared_folder
from .fixtures import ANNOS, CALLS, LR, TEXTS, plain, view
from .learning import _S, _pairs, _vectors


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "SELECT o_orderkey AS id, o_custkey AS c, o_orderpriority AS p FROM {orders}")


def _shown(values: Column) -> Column:
    return F.array_join(values.cast("array<string>"), ",")


def prompt_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caption, slices and place that a prompt names, with numbers that are none among them."""
    n = F.col("id").cast("string")
    words = F.concat(
        F.when(F.col("id") % 3 > 0, F.concat(F.lit('The target structure is: "'), F.col("p"), F.lit('". '))).otherwise(""), F.lit("This image is slice "), n, F.lit(" out of "), F.col("c").cast("string"),
        F.lit("\nSampled Z list (3): [4, x, 99999999999]\nZ=7: <image>\nZ=9 shows it, Z="), n, F.lit(": and Z=88888888888: too"),
    )
    d = _orders(spark, sf_dir).withColumn("t", words)
    t = F.col("t")
    return d.select(
        "id", F.coalesce(text.caption_of(t), F.lit("none")).alias("caption"), text.slice_of(t)["slice"].alias("slice"), text.slice_of(t)["slices"].alias("slices"), _shown(text.sampled_slices(t)).alias("sampled"),
        _shown(text.marked_slices(t)).alias("marked"), _shown(text.listed_slices(t)).alias("listed"),
    )


def box_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lists of boxes: plain, named, mixed, in single quotes, short, and cut off."""
    k, c = F.col("id") % 6, F.col("c").cast("string")
    one = F.concat(F.lit("[1, 2, "), c, F.lit(", 4.5]"))
    t = (
        F.when(k == 0, F.concat(F.lit("so ["), one, F.lit("]"))).when(k == 1, F.concat(F.lit('[{"bbox_2d": '), one, F.lit('}, {"box": [5, 6, 7, 8]}]')))
        .when(k == 2, F.concat(F.lit("[{'bbox': "), one, F.lit("}, [0, 0, 9, 9]]"))).when(k == 3, F.concat(F.lit("["), one, F.lit(", [1, 2, 3]]"))).when(k == 4, F.concat(F.lit("["), one)).otherwise("[]")
    )
    d = _orders(spark, sf_dir).withColumn("b", text.json_boxes(t))
    return d.select("id", F.coalesce(F.array_join(F.transform("b", lambda b: F.format_string("%.1f,%.1f,%.1f,%.1f", b["x1"], b["y1"], b["x2"], b["y2"])), ";"), F.lit("none")).alias("boxes"))


def marked_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c").cast("string")
    t = F.concat(F.lit("a <|object_ref_start|>the cyst<|object_ref_end|><|box_start|>("), c, F.lit(",2),(30,40)<|box_end|> and <|object_ref_start|>"), F.col("p"), F.lit("<|object_ref_end|><|box_start|>(5,6),(7,"), c, F.lit(")<|box_end|>"))
    d = _orders(spark, sf_dir).withColumn("r", text.referred_boxes(t))
    return d.select("id", F.array_join(F.transform("r", lambda r: r["name"]), ",").alias("names"), F.array_join(F.transform("r", lambda r: F.format_string("%.0f-%.0f", r["box"]["x1"], r["box"]["y2"])), ",").alias("ends"))


def caption_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions of labels, their colors by first appearance, and number texts."""
    d = view(spark, sf_dir, "SELECT p_partkey AS id, p_size, p_brand FROM {part}")
    label = F.when(F.col("id") % 9 == 0, "Background").when(F.col("id") % 9 == 1, "").otherwise(F.concat(F.lit("Organ "), (F.col("id") % 5).cast("string")))
    names = F.create_map(F.lit("Organ 1"), F.lit("Liver"), F.lit("Organ 2"), F.lit(" spleen "))
    terms = F.create_map(F.lit("liver"), F.array(F.lit("the large gland"), F.lit("the bile maker")), F.lit("organ 3"), F.array(F.lit("the third")), F.lit("Organ 4"), F.array().cast("array<string>"))
    colors = text.color_places(F.array(*(F.concat(F.lit("n"), ((F.col("id") * k) % 4).cast("string")) for k in range(6))), 3)
    coords = text.four_coordinates(F.concat(F.lit("box "), (F.col("id") * 7).cast("string"), F.lit(", 12 2000 34 and "), F.col("p_size").cast("string"), F.lit(" 5")))
    return d.select(
        "id", F.coalesce(text.label_caption(label, names, terms, F.col("id")), F.lit("none")).alias("caption"), _shown(colors).alias("colors"), F.coalesce(_shown(coords), F.lit("none")).alias("coords"),
        text.to_double(F.when(F.col("id") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_brand")), -1.0).alias("number"), text.prompt("size %d of %s", F.col("p_size").cast("int"), F.col("p_brand")).alias("prompt"),
    )


def first_renders(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.concat(F.lit("v"), F.col("c").cast("string"))
    paths = F.array(F.lit("/a/plain.jpg"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("/r/"), v, F.lit("_z003_raw.png"))).otherwise("/r/x_z1_other.png"), F.lit("/r/last_z9_mask.png"))
    return _orders(spark, sf_dir).select("id", text.first_volume(paths).alias("vid"))


def box_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in thousandths, row first, in a square image; overlaps of unknown slices; colors of overlaps."""
    d = view(spark, sf_dir, f"WITH {LR} SELECT * FROM gt")
    b = tuple(F.col(c) for c in ("x1", "y1", "x2", "y2"))
    w, h = F.lit(640.0), F.lit(480.0)
    rows, square = geometry.scale_box(b, w, h, rows_first=True), geometry.to_square(b, w, h)
    known = F.when(F.col("g") % 3 > 0, F.lit(True))
    kind = geometry.overlap_class(F.col("x1") % 2 == 0, F.col("y1") % 3 == 0)
    return d.select(
        "rec", "g", F.round(rows["x1"], 6).alias("x1"), F.round(rows["y2"], 6).alias("y2"), F.round(square["x2"].cast("double"), 2).alias("sx2"), geometry.slice_iou(F.col("x1") / 512.0, known).alias("iou"), kind.alias("kind"),
        geometry.blend(F.col("x1") % 256, F.lit(255.0)).alias("red"),
    )


def tight_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of true boxes with the tight boxes of predicted masks, which do not widen their far edges."""
    keys = ["rec", "z"]
    pred = masks.tight_boxes(masks.box_strips(view(spark, sf_dir, f"WITH {LR} SELECT rec, p AS z, x1, y1, x2, y2 FROM pc"), keys), keys)
    true = view(spark, sf_dir, f"WITH {LR} SELECT rec, g AS z, x1 AS a1, y1 AS b1, x2 AS a2, y2 AS b2 FROM gt")
    d = true.join(pred, keys, "left")
    iou = geometry.tight_box_iou(tuple(F.col(c) for c in ("a1", "b1", "a2", "b2")), tuple(F.col(c) for c in ("x1", "y1", "x2", "y2")), F.col("area").isNull())
    return d.select("rec", "z", F.round(iou, 6).alias("iou"))


def overlap_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of each class of the overlap map, by record."""
    keys = ["rec", "z"]
    true, pred = (masks.box_strips(view(spark, sf_dir, f"WITH {LR} SELECT rec, {n} AS z, x1, y1, x2, y2 FROM {t}"), keys) for n, t in (("g", "gt"), ("p", "pc")))
    out = None
    for kind, how, a, b in (("hit", "and", true, pred), ("missed", "minus", true, pred), ("false", "minus", pred, true)):
        d = masks.combine(a, b, keys, how).groupBy("rec").agg(F.sum(F.col("length") * F.col("columns")).cast("bigint").alias("pixels")).withColumn("kind", F.lit(kind))
        out = d if out is None else out.unionByName(d)
    return out.select("rec", "kind", "pixels")


def deeper_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stacks of few slices as ten, and maps with values put over."""
    d = _orders(spark, sf_dir)
    places = F.sequence(F.lit(0), (F.col("id") % 13).cast("int"))
    base, over = F.create_map(F.lit("a"), F.col("id"), F.lit("b"), F.col("c")), F.create_map(F.lit("b"), F.lit(7).cast("bigint"), F.lit("c"), F.col("c"))
    merged = an.overridden(base, over)
    return d.select("id", _shown(arrays.upsampled(places, 10)).alias("places"), F.array_join(F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat(e["key"], e["value"].cast("string"))), ",").alias("merged"))


def react_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, _REACT)
    m = trajectory.merge_turns(d, form="react", tools=F.lit("scroll: moves"))
    return m.groupBy("rec").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "system").alias("openings"), F.sum(F.length("content").cast("bigint")).alias("chars"), F.count_if(F.col("content").contains("Action Input: {")).alias("actions"))


_REACT = f"""WITH {CALLS} SELECT rec, pos, CASE WHEN name = 'get_slice' THEN 'assistant' WHEN name = 'scroll' THEN 'tool_call' WHEN name = 'add_bbox' THEN 'tool_response' ELSE 'user' END AS role,
  CASE WHEN name = 'scroll' THEN to_json(named_struct('name', 'scroll', 'arguments', named_struct('delta', delta))) ELSE name END AS content FROM calls"""


def aligned_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media ids repeated by the sizes of their grids, with labels and weights alongside."""
    ints = lambda *v: F.array(*map(F.lit, v))
    grid = trajectory.media_tokens(F.lit(1), (F.col("c") % 3 + 1) * 2, F.lit(4))
    sound = trajectory.audio_tokens(F.col("c") % 40 + 8)
    out = trajectory.expand_aligned(ints(5, -1, 6, -1), ints(-100, -100, 6, -100), F.array(F.lit(1.0), F.lit(0.5), F.lit(2.0), F.lit(0.25)), -1, F.array(grid, sound))
    d = _orders(spark, sf_dir).withColumn("r", out)
    return d.select("id", F.size("r").cast("bigint").alias("n"), F.aggregate("r", F.lit(0.0), lambda s, x: s + x["weight"]).alias("weight"), F.size(F.filter("r", lambda x: x["label"] != -100)).cast("bigint").alias("labels"))


def named_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses by name over the vector pairs."""
    p = _pairs(spark, sf_dir).select((1 - losses.cosine(F.col("a"), F.col("b"))).alias("d"), "y")
    out = None
    for name in ("cosine_similarity", "contrastive", "online_contrastive"):
        d = registry.LOSSES[name](p).select(F.lit(name).alias("name"), F.round("loss", 6).alias("loss"))
        out = d if out is None else out.unionByName(d)
    return out


def infonce_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 32 pairs, the queries' and the documents' own blocks among the denominators."""
    v = _vectors(spark, sf_dir).withColumn("batch", F.floor(F.col("vec_id") / 64)).withColumn("pair", F.floor(F.col("vec_id") / 2))
    q = v.filter("vec_id % 2 = 0").select("batch", F.col("pair").alias("query"), F.col("embedding").alias("v"))
    k = v.filter("vec_id % 2 = 1").select("batch", F.col("pair").alias("doc"), F.col("pair").alias("of"), F.col("embedding").alias("v"))
    return losses.info_nce(losses.score_blocks(q, k, "batch", with_queries=True, with_docs=True)).select("query", F.round("loss", 6).alias("loss"))


def infonce_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of an anchor, its positive and negatives, of which the first two stay."""
    v = _vectors(spark, sf_dir).withColumn("batch", F.floor(F.col("vec_id") / 50)).withColumn("label", F.when(F.col("vec_id") % 5 == 1, 1).otherwise(0))
    g = losses.embedding_groups(v, "vec_id", "label", "batch", negatives=2)
    anchor = g.filter("role = 'anchor'").select("batch", "grp", F.col("vec_id").alias("query"), F.col("embedding").alias("a"))
    rest = g.filter("role <> 'anchor'").select("batch", "grp", F.col("vec_id").alias("doc"), F.col("embedding").alias("b"), (F.col("role") == "positive").alias("positive"), "place")
    d = anchor.join(rest, ["batch", "grp"]).select("query", "doc", losses.cosine(F.col("a"), F.col("b")).alias("sim"), "positive", F.when(~F.col("positive"), F.col("place")).alias("place"))
    return losses.info_nce(d, in_group=True, negatives=2).select("query", F.round("loss", 6).alias("loss"))


def weighted_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages cut by patterns: an empty thought weighs nothing, an answer twice."""
    t = F.concat(F.when(F.col("id") % 2 == 0, "<think>\n\n</think>").otherwise("<think>so</think>"), F.lit("well "), F.when(F.col("id") % 3 == 0, F.concat(F.lit("<answer>"), F.col("p"), F.lit("</answer>"))).otherwise(F.col("p")))
    s = losses.loss_weights(t, [(r"<think>\s*</think>", 0.0), ("<answer>.*?</answer>", 2.0)])
    return _orders(spark, sf_dir).select("id", F.size(s).cast("bigint").alias("n"), F.array_join(F.transform(s, lambda x: F.concat(F.format_string("%.1f", x["weight"]), F.lit(":"), F.length(x["text"]).cast("string"))), ",").alias("parts"))


def box_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, f"""WITH {LR} SELECT CAST(l_partkey % 37 AS DOUBLE) / 8.0 AS loss, CASE WHEN l_suppkey % 6 = 0 THEN -100 ELSE 1 END AS label, l_partkey % 3 = 0 AS in_span,
      CASE WHEN l_partkey % 3 = 0 THEN bx1 END AS coord, CASE WHEN l_partkey % 3 = 0 THEN bx1 + l_suppkey % 200 END AS truth FROM bx""")
    return registry.LOSSES["mri_bbox"](d).select(F.round("loss", 6).alias("loss"))


def prediction_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, f"WITH {TEXTS} SELECT * FROM tx")
    d = d.withColumn("error", text.parse_error(F.col("text"), text.cascade_boxes(F.col("text")))).withColumn("seconds", (F.col("id") % 16) / 4.0)
    return metrics.latency(d, "seconds", "error").select("n", F.round("mean_latency", 6).alias("mean_latency"), "parse_failures")


def split_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = view(spark, sf_dir, f"WITH {ANNOS} SELECT vid, eid, CASE WHEN o_custkey % 10 = 0 THEN 'val' ELSE 'train' END AS split, o_orderkey % 3 AS n_masks FROM an")
    return writers.split_totals(d)


def record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation lines written as JSON lines with blank and broken ones between, and read by line number."""
    folder = shared_folder(spark, "records")
    d = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("r", F.to_json(F.struct("conv_id", "turn", "role")))
    value = F.when(F.col("turn") % 4 == 3, "").when(F.col("conv_id") % 7 == 0, "{broken").otherwise(F.col("r"))
    d.select(value.alias("value")).repartition(3).write.mode("overwrite").text(folder)
    rows = readers.read_records(spark, folder, "conv_id long, turn int, role string", numbered=True)
    first = readers.read_records(spark, folder, "conv_id long, turn int, role string", most_parsed=5)
    per = rows.groupBy("file").agg(F.count_distinct("line").alias("lines"), F.count("*").alias("n")).agg(F.sum(F.col("n") - F.col("lines")).alias("repeated"))
    whole = rows.agg(F.count("*").alias("n"), F.count_if(F.col("conv_id").isNull()).alias("unreadable"), F.sum("turn").cast("bigint").alias("turns"))
    return whole.crossJoin(per).crossJoin(first.agg(F.max("line").isNotNull().alias("some"), F.count("*").alias("first")))  # single rows


def mask_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks written with compressed run lengths and read again."""
    folder = shared_folder(spark, "masks")
    boxes = view(spark, sf_dir, f"WITH {LR} SELECT rec AS anno_id, g AS z, x1, y1, x2, y2 FROM gt")
    writers.write_masks(masks.box_strips(boxes, ["anno_id", "z"]), folder, masks.SIDE, masks.SIDE)
    return masks.mask_areas(readers.read_masks(spark, folder, wide=True), ["anno_id", "z"])


def volume_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order counts as volumes of 12 x 5 x 7 in .npy files, read again along the last axis."""
    folder = shared_folder(spark, "volumes")
    d = view(spark, sf_dir, "SELECT concat('v', CAST(o_custkey % 8 AS STRING)) AS file, CAST(o_orderkey % 12 AS INT) AS z, CAST(o_orderkey % 5 * 7 + o_custkey % 7 AS INT) AS i FROM {orders}")
    counts = F.map_from_entries(F.collect_list(F.struct("i", "n")))
    known = d.groupBy("file", "z", "i").agg(F.count("*").cast("int").alias("n")).groupBy("file", "z").agg(counts.alias("counts"))
    whole = d.select("file").distinct().select("file", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("z")).join(known, ["file", "z"], "left")
    pixels = F.transform(F.sequence(F.lit(0), F.lit(34)), lambda i: F.coalesce(F.col("counts")[i], F.lit(0)))
    size = (F.lit(n).alias(k) for k, n in (("depth", 12), ("height", 5), ("width", 7)))
    volumes.write_volumes(whole.select("file", "z", *size, pixels.alias("pixels")), folder, "int")
    r = volumes.read_volumes(spark, folder, axis="axial", values="int")
    name = F.regexp_extract("file", r"([^/]+)\.npy$", 1)
    moment = F.aggregate(F.transform("pixels", lambda v, i: v.cast("bigint") * i), F.lit(0).cast("bigint"), lambda a, b: a + b)
    total = F.aggregate("pixels", F.lit(0).cast("bigint"), lambda a, b: a + b)
    return r.select(name.alias("file"), "z", "height", "width", total.alias("total"), moment.alias("moment"))


def metadata_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos' metadata as JSON, by the keys of its parts."""
    d = view(spark, sf_dir, f"WITH {ANNOS} SELECT vid, eid, caption FROM an").select("vid", "eid", "caption", F.lit("1").alias("obj_id"), F.array(F.lit("00000"), F.lit("00001")).alias("frames"), F.lit(512).alias("img_h"), F.lit(512).alias("img_w"))
    m = writers.metadata_lines(d)
    e = F.from_json(F.get_json_object("video", "$.expressions"), "map<string, struct<exp: string, obj_id: string>>")
    return m.select("vid", F.size(e).cast("bigint").alias("expressions"), F.get_json_object("video", "$.height").cast("int").alias("height"), F.array_join(F.array_sort(F.map_keys(e)), ",").alias("eids"))


SQL = {
    "prompt_parts": """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority ELSE 'none' END AS caption, o_orderkey::INT AS slice, o_custkey::INT AS slices, '4' AS sampled, '7,9,' || o_orderkey AS marked, '7,' || o_orderkey AS listed FROM orders""",
    "box_lists": """WITH q AS (SELECT o_orderkey AS id, o_orderkey % 6 AS k, '1.0,2.0,' || format('{:.1f}', o_custkey::DOUBLE) || ',4.5' AS b FROM orders)
      SELECT id, CASE k WHEN 0 THEN b WHEN 1 THEN b || ';5.0,6.0,7.0,8.0' WHEN 2 THEN b || ';0.0,0.0,9.0,9.0' ELSE 'none' END AS boxes FROM q""",
    "marked_objects": "SELECT o_orderkey AS id, 'the cyst,' || o_orderpriority AS names, o_custkey || '-40,5-' || o_custkey AS ends FROM orders",
    "caption_texts": """WITH q AS (SELECT p_partkey AS id, p_size, p_brand, list_transform(range(6), lambda k: (p_partkey * k) % 4) AS n FROM part), u AS (SELECT *, list_filter(n, lambda x, i: list_position(n, x) = i) AS f FROM q)
      SELECT id, CASE WHEN id % 9 <= 1 THEN 'none' WHEN id % 5 = 1 THEN CASE WHEN id % 2 = 0 THEN 'the large gland' ELSE 'the bile maker' END WHEN id % 5 = 2 THEN 'The spleen in the MRI scan.' WHEN id % 5 = 3 THEN 'the third' ELSE 'The Organ ' || id % 5 || ' in the MRI scan.' END AS caption,
        array_to_string(list_transform(n, lambda x: (list_position(f, x) - 1) % 3), ',') AS colors,
        array_to_string(list_slice(list_filter(list_transform(regexp_extract_all('box ' || id * 7 || ', 12 2000 34 and ' || p_size || ' 5', '\\d{1,4}'), lambda x: x::INT), lambda x: x <= 1000), 1, 4), ',') AS coords,
        CASE WHEN id % 2 = 0 THEN p_size ELSE -1 END::DOUBLE AS number, 'size ' || p_size || ' of ' || p_brand AS prompt FROM u""",
    "first_renders": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'v' || o_custkey ELSE 'last' END AS vid FROM orders",
    "box_forms": f"""WITH {plain(LR)} SELECT rec, g, round(y1 / 1000.0::DOUBLE * 640, 6) AS x1, round(x2 / 1000.0::DOUBLE * 480, 6) AS y2, round((x2 * 512.0::DOUBLE / 640.0::DOUBLE)::FLOAT::DOUBLE, 2) AS sx2,
      CASE WHEN g % 3 > 0 THEN round_even(x1 / 512.0::DOUBLE, 3) ELSE 0 END::DOUBLE AS iou, CASE WHEN x1 % 2 = 0 AND y1 % 3 = 0 THEN 'hit' WHEN y1 % 3 = 0 THEN 'missed' WHEN x1 % 2 = 0 THEN 'false' ELSE 'none' END AS kind,
      floor(x1 % 256 * 0.55::DOUBLE + 255.0::DOUBLE * 0.45::DOUBLE)::INT AS red FROM gt""",
    "tight_overlaps": f"""WITH {plain(LR)}, j AS (SELECT a.rec, a.g AS z, b.x1 IS NULL AS none, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s
      FROM gt a LEFT JOIN pc b ON a.rec = b.rec AND a.g = b.p) SELECT rec, z, CASE WHEN none THEN 1 WHEN i > 0 THEN round(i / (s - i)::DOUBLE, 6) ELSE 0 END::DOUBLE AS iou FROM j""",
    "overlap_map": f"""WITH {plain(LR)}, a AS (SELECT rec, g AS z, x1, y1, x2, y2 FROM gt), b AS (SELECT rec, p AS z, x1, y1, x2, y2 FROM pc),
      q AS (SELECT rec, coalesce((a.x2 - a.x1 + 1) * (a.y2 - a.y1 + 1), 0) AS ga, coalesce((b.x2 - b.x1 + 1) * (b.y2 - b.y1 + 1), 0) AS pa, CASE WHEN a.x1 IS NULL OR b.x1 IS NULL THEN 0
        ELSE greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1) + 1) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1) + 1) END AS sh FROM a FULL JOIN b USING (rec, z)),
      s AS (SELECT rec, unnest(['hit', 'missed', 'false']) AS kind, unnest([sum(sh), sum(ga - sh), sum(pa - sh)])::BIGINT AS pixels FROM q GROUP BY rec) SELECT * FROM s WHERE pixels > 0""",
    "deeper_stacks": """WITH q AS (SELECT o_orderkey AS id, o_custkey AS c, (o_orderkey % 13 + 1)::INT AS n FROM orders)
      SELECT id, array_to_string(list_transform(range(10), lambda i: CASE WHEN n >= 10 THEN i WHEN i < n * (10 // n) THEN i // (10 // n) ELSE i - n * (10 // n) END), ',') AS places, 'a' || id || ',b7,c' || c AS merged FROM q""",
    "react_turns": f"""WITH {plain(CALLS)}, t AS (SELECT rec, pos, name, CASE WHEN name IN ('get_slice', 'scroll') THEN 'assistant' ELSE 'user' END AS role, CASE name WHEN 'scroll' THEN 39 + len(delta::VARCHAR) WHEN 'add_bbox' THEN 21 ELSE len(name) END AS n FROM calls),
      i AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY rec ORDER BY pos) = role THEN 0 ELSE 1 END AS new, CASE WHEN lag(role) OVER (PARTITION BY rec ORDER BY pos) = role THEN 0 ELSE 1 END AS k FROM t),
      g AS (SELECT rec, sum(new) OVER (PARTITION BY rec ORDER BY pos) AS turn, * EXCLUDE (rec) FROM i), a AS (SELECT rec, turn, bool_or(name = 'scroll') AS act FROM g GROUP BY ALL)
      SELECT rec, (sum(new) + 1)::BIGINT AS turns, 1::BIGINT AS openings, (sum(n + 1 - new) + 13)::BIGINT AS chars, (SELECT count(*) FROM a WHERE a.rec = g.rec AND act) AS actions FROM g GROUP BY rec""",
    "aligned_media": """WITH q AS (SELECT o_orderkey AS id, ((o_custkey % 3 + 1) * 2)::BIGINT AS m, ((((o_custkey % 40 + 7) // 2 + 1) - 2) // 2 + 1)::BIGINT AS s FROM orders) SELECT id, 2 + m + s AS n, 3.0::DOUBLE + 0.5::DOUBLE * m + 0.25::DOUBLE * s AS weight, 1::BIGINT AS labels FROM q""",
    "infonce_blocks": f"""{_S}, v AS (SELECT vec_id // 64 AS b, vec_id // 2 AS pair, vec_id % 2 AS side, embedding::DOUBLE[] AS e FROM embeddings), o AS (SELECT x.side, x.pair AS query, list_cosine_similarity(x.e, y.e) AS sim FROM v x JOIN v y ON x.b = y.b AND x.side = y.side AND x.pair <> y.pair),
      m AS (SELECT DISTINCT query, pos FROM t WHERE pos IS NOT NULL), al AS (SELECT query, sim FROM s UNION ALL SELECT query, sim FROM o)
      SELECT query, round(ln(sum(exp(sim * 10 - pos * 10))), 6) AS loss FROM al JOIN m USING (query) GROUP BY query""",
    "infonce_groups": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.vec_id AS query, b.vec_id % 5 AS k, list_cosine_similarity(a.e, b.e) AS sim FROM v a JOIN v b ON b.vec_id BETWEEN a.vec_id + 1 AND a.vec_id + 3 WHERE a.vec_id % 5 = 0),
      m AS (SELECT query, max(sim) AS pos FROM s WHERE k = 1 GROUP BY query) SELECT query, round(ln(sum(exp(sim * 10 - pos * 10))), 6) AS loss FROM s JOIN m USING (query) GROUP BY query""",
    "weighted_segments": """SELECT o_orderkey AS id, (CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END + 1)::BIGINT AS n, CASE WHEN o_orderkey % 2 = 0 THEN '0.0:17,' ELSE '' END ||
      '1.0:' || (CASE WHEN o_orderkey % 2 = 0 THEN 5 ELSE 22 END + CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE len(o_orderpriority) END) || CASE WHEN o_orderkey % 3 = 0 THEN ',2.0:' || (len(o_orderpriority) + 17) ELSE '' END AS parts FROM orders""",
    "box_loss": f"""WITH {plain(LR)}, t AS (SELECT CAST(l_partkey % 37 AS DOUBLE) / 8.0 AS loss, CASE WHEN l_partkey % 3 = 0 THEN 3.0 ELSE 1.0 END::DOUBLE AS w, CASE WHEN l_partkey % 3 = 0 THEN l_suppkey % 200 / 1000.0::DOUBLE END AS d FROM bx WHERE l_suppkey % 6 <> 0)
      SELECT round(sum(loss * w) / sum(w) + 0.05 * avg(CASE WHEN d < 0.1 THEN 0.5 * d * d / 0.1::DOUBLE ELSE d - 0.05 END), 6) AS loss FROM t""",
    "prediction_latency": "SELECT count(*) AS n, round(avg(o_orderkey % 16 / 4.0::DOUBLE), 6) AS mean_latency, count(*) FILTER (o_orderkey % 6 IN (0, 5)) AS parse_failures FROM orders",
    "split_totals": f"""WITH {plain(ANNOS)}, q AS (SELECT vid, CASE WHEN o_custkey % 10 = 0 THEN 'val' ELSE 'train' END AS split, o_orderkey % 3 AS m FROM an)
      SELECT coalesce(split, 'all') AS split, count(DISTINCT vid) AS videos, count(*) AS expressions, count(*) FILTER (m > 0) AS with_masks FROM q GROUP BY ROLLUP (split)""",
    "record_files": """WITH q AS (SELECT * FROM conversations WHERE turn % 4 <> 3) SELECT count(*) AS n, count(*) FILTER (conv_id % 7 = 0) AS unreadable, sum(CASE WHEN conv_id % 7 > 0 THEN turn END)::BIGINT AS turns, 0::BIGINT AS repeated, true AS some, 15::BIGINT AS first FROM q""",
    "mask_files": f"WITH {plain(LR)} SELECT rec AS anno_id, g AS z, ((x2 - x1 + 1) * (y2 - y1 + 1))::BIGINT AS area FROM gt",
    "volume_slices": """WITH q AS (SELECT 'v' || (o_custkey % 8) AS file, (o_custkey % 7)::INT AS z, (o_orderkey % 12 * 5 + o_orderkey % 5)::BIGINT AS spot FROM orders),
      g AS (SELECT DISTINCT 'v' || (o_custkey % 8) AS file, unnest(range(7))::INT AS z FROM orders)
      SELECT file, z, 12 AS height, 5 AS width, count(spot) AS total, coalesce(sum(spot), 0)::BIGINT AS moment FROM g LEFT JOIN q USING (file, z) GROUP BY file, z""",
    "metadata_files": f"WITH {plain(ANNOS)} SELECT vid, count(*) AS expressions, 512 AS height, string_agg(eid, ',' ORDER BY eid) AS eids FROM an GROUP BY vid",
}
SQL["named_losses"] = """WITH p AS (SELECT a.vec_id // 2 AS pair, 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d, CASE WHEN (a.vec_id // 2) % 3 = 0 THEN 1 ELSE 0 END AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0),
e AS (SELECT CASE WHEN count(*) FILTER (y = 1) > 1 THEN max(d) FILTER (y = 1) ELSE avg(d) FILTER (y = 0) END AS under, CASE WHEN count(*) FILTER (y = 0) > 1 THEN min(d) FILTER (y = 0) ELSE avg(d) FILTER (y = 1) END AS over FROM p)
SELECT 'cosine_similarity' AS name, round(avg((1 - d - y) * (1 - d - y)), 6) AS loss FROM p UNION ALL SELECT 'contrastive', round(avg(0.5 * (y * d * d + (1 - y) * pow(greatest(0.5 - d, 0), 2))), 6) FROM p
UNION ALL SELECT 'online_contrastive', round(coalesce(sum(CASE WHEN y = 1 AND d > over THEN d * d WHEN y = 0 AND d < under THEN pow(greatest(0.5 - d, 0), 2) END), 0), 6) FROM p, e"""

QUERIES = {name: globals()[name] for name in SQL}
