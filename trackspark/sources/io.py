"""Readers and writers (S1 to S15). Every schema is given, none inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackspark.functions.graph import Rounds
from trackspark.schema import CELLS, stored

PATH = "_metadata.file_path"


# -- frames ---------------------------------------------------------------------------------------


def frame_manifest(files: DataFrame, max_img_num: int | None = None) -> DataFrame:
    """Files (dataset, path): time is the rank of the path; a cap keeps the lowest times."""
    t = F.row_number().over(Window.partitionBy("dataset").orderBy("path")) - 1
    out = files.select("dataset", t.alias("timeframe"), F.col("path").alias("url"))
    return out if max_img_num is None else out.where(F.col("timeframe") < max_img_num)


def list_files(spark: SparkSession, folder: str, glob: str = "*.tif", dataset: str = "") -> DataFrame:
    """Paths of a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    return files.select(F.lit(dataset).alias("dataset"), "path")


MANIFEST = "name STRING, ext STRING, dir STRING, time2url MAP<STRING, STRING>"


def read_manifest_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(name, timeframe, url); keys are cast to int. multi_line: one object a file, else one a line."""
    m = spark.read.schema(MANIFEST).option("multiLine", multi_line).json(path)
    return m.select("name", F.explode("time2url").alias("t", "url")).select("name", F.col("t").cast("double").cast("int").alias("timeframe"), "url")


def write_manifest_json(frames: DataFrame, path: str) -> None:
    """One object per name."""
    entry = F.struct(F.col("timeframe").cast("string"), "url")
    m = frames.groupBy("name").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("time2url"))
    m.write.mode("overwrite").json(path)


# -- cells and tracks -----------------------------------------------------------------------------


def read_cells_json(spark: SparkSession, paths: str | list[str], multi_line: bool = True) -> DataFrame:
    """S3: stored cells; the source file goes to meta.src_json."""
    c = spark.read.schema(CELLS).option("multiLine", multi_line).json(paths)
    meta = F.map_concat(F.map_filter(F.coalesce("meta", F.create_map().cast("map<string,string>")), lambda k, _: k != "src_json"), F.create_map(F.lit("src_json"), F.col(PATH)))
    return c.withColumn("meta", meta)


def write_cells_json(cells: DataFrame, path: str) -> None:
    """JSON lines of the stored form, from either form."""
    (cells if "bbox" in cells.columns else stored(cells)).write.mode("overwrite").json(path)


_CELL = CELLS.simpleString()
_TRACKS = f"MAP<STRING, STRUCT<track_id: BIGINT, timeframe_to_single_cell: MAP<STRING, {_CELL}>, meta: MAP<STRING, STRING>>>"


def _cells_of_tracks(texts: DataFrame) -> DataFrame:
    """value: {track id: {track_id, timeframe_to_single_cell, meta}} as cells with ``track_meta``. Keys are cast
    to numbers and are the track and frame of a cell whatever the cell says."""
    t = texts.select(F.explode(F.from_json("value", _TRACKS)).alias("k", "t"))
    number = lambda c, kind: F.col(c).cast("double").cast(kind)
    t = t.select(number("k", "bigint").alias("__id"), F.col("t.meta").alias("track_meta"), F.explode("t.timeframe_to_single_cell").alias("f", "c"))
    own = {"track_id": F.col("__id"), "timeframe": number("f", "int")}
    return t.select(*[own.get(n, F.col(f"c.{n}")).alias(n) for n in CELLS.names], "track_meta")


def read_tracks_json(spark: SparkSession, path: str) -> DataFrame:
    """Files of {track id: {track_id, timeframe_to_single_cell, meta}}: cells with their track's meta, which
    holds mothers and daughters. A file is one row, so one task's work; ``read_track_lines`` reads lines."""
    return _cells_of_tracks(spark.read.text(path, wholetext=True))


def write_tracks_json(cells: DataFrame, path: str, tracks: DataFrame | None = None) -> None:
    """A line per track of a dataset, {track id: {track_id, timeframe_to_single_cell, meta}}; tracks without a
    contour are left out first. tracks: (dataset, track_id, meta MAP<STRING, STRING>); none: empty maps. The
    dataset stands in each cell, so tracks of equal number of two movies stay two."""
    key = ["dataset", "track_id"]
    entry = F.struct(F.col("timeframe").cast("string"), F.struct(*[F.col(n) for n in CELLS.names]))
    has = F.max(F.coalesce(F.size("contour") > 0, F.lit(False))).alias("__has")
    t = cells.groupBy(*key).agg(F.map_from_entries(F.collect_list(entry)).alias("timeframe_to_single_cell"), has).where("__has").drop("__has")
    empty = F.create_map().cast("map<string, string>")
    if tracks is None:
        t = t.withColumn("meta", empty)
    else:
        m = tracks.select(F.col("dataset").alias("__d"), F.col("track_id").alias("__t"), "meta")
        t = t.join(m, F.col("dataset").eqNullSafe(F.col("__d")) & F.col("track_id").eqNullSafe(F.col("__t")), "left").withColumn("meta", F.coalesce("meta", empty))
    text = F.to_json(F.create_map(F.col("track_id").cast("string"), F.struct("track_id", "timeframe_to_single_cell", "meta")))
    t.select(text.alias("value")).write.mode("overwrite").text(path)


def read_track_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines that S6 writes, one track each."""
    return _cells_of_tracks(spark.read.text(path))


# -- annotations ----------------------------------------------------------------------------------

COCO = (
    "images ARRAY<STRUCT<id: BIGINT, file_name: STRING, height: INT, width: INT>>, "
    "annotations ARRAY<STRUCT<id: BIGINT, image_id: BIGINT, category_id: BIGINT, bbox: ARRAY<DOUBLE>, segmentation: ARRAY<ARRAY<DOUBLE>>>>, "
    "categories ARRAY<STRUCT<id: BIGINT, name: STRING>>"
)


def _swapped(flat: Column) -> Column:
    """[x0, y0, x1, y1, ...] as (row, col) points."""
    n = (F.size(flat) / 2).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array(F.get(flat, 2 * i + 1), F.get(flat, 2 * i)))).otherwise(F.array().cast("array<array<double>>"))


def coco_cells(coco: DataFrame) -> DataFrame:
    """Coco (COCO schema): one cell per annotation: its polygon with points turned to (row, col), box
    [x, y, w, h] as [y, x, y + h, x + w]; where the contour reaches an upper end, that is the contour's plus
    1; frame = image id. An annotation of several polygons is an error: none of them is the cell."""
    a = coco.select(F.explode("annotations").alias("a")).select("a.*")
    i = coco.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), "i.file_name")
    several = F.format_string("annotation %s has several polygons", F.col("id").cast("string"))
    one = F.when(F.size("segmentation") > 1, F.raise_error(several)).otherwise(F.get("segmentation", F.lit(0)))
    c = a.join(i, "image_id").withColumn("contour", _swapped(one))
    b = lambda k: F.get("bbox", F.lit(k))
    top = lambda k: F.array_max(F.transform("contour", lambda p: F.get(p, F.lit(k))))
    end = lambda e, k: F.when(top(k) >= e, top(k) + 1).otherwise(e)
    return c.select(
        F.col("id").alias("sc_id"), F.col("image_id").cast("int").alias("timeframe"), "file_name", "category_id", "contour",
        b(1).alias("x1"), b(0).alias("y1"), end(b(1) + b(3), 0).alias("x2"), end(b(0) + b(2), 1).alias("y2"),
    )


def read_coco(spark: SparkSession, path: str) -> DataFrame:
    """S7."""
    return coco_cells(spark.read.schema(COCO).option("multiLine", True).json(path))


LABELME = "imagePath STRING, imageHeight INT, imageWidth INT, shapes ARRAY<STRUCT<label: STRING, shape_type: STRING, points: ARRAY<ARRAY<DOUBLE>>>>"


def labelme_rows(files: DataFrame, train_share: float = 1.0, seed: int = 0) -> DataFrame:
    """Files (LABELME schema and path): a row per shape: image id from the stem, category id by the first
    appearance of its label, rectangles as boxes [x, y, w, h], polygons flat; split by a hash of the image."""
    s = files.select("path", F.posexplode("shapes").alias("pos", "s"))
    image = F.regexp_extract("path", r"([0-9]+)\.[^.]*$", 1).cast("long")
    first = s.groupBy(F.col("s.label").alias("label")).agg(F.min(F.struct("path", "pos")).alias("f"))
    ids = first.select("label", (F.row_number().over(Window.orderBy("f"))).cast("long").alias("category_id"))  # one row per label
    xs, ys = F.transform("s.points", lambda p: F.get(p, F.lit(0))), F.transform("s.points", lambda p: F.get(p, F.lit(1)))
    box = F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))
    polygon = F.col("s.shape_type") == "polygon"
    unit = F.pmod(F.xxhash64("path", F.lit(seed)), F.lit(1000)) / 1000
    return s.select(F.col("path"), "pos", image.alias("image_id"), F.col("s.label").alias("label"), box.alias("bbox"), F.when(polygon, F.flatten("s.points")).alias("segmentation"), F.when(unit < train_share, "train").otherwise("val").alias("split")).join(ids, "label")


def read_labelme(spark: SparkSession, folder: str, **options) -> DataFrame:
    """S8."""
    files = spark.read.schema(LABELME).option("multiLine", True).option("recursiveFileLookup", True).json(folder)
    return labelme_rows(files.withColumn("path", F.col(PATH)), **options)


def _tags(spark: SparkSession, path: str, names: str) -> DataFrame:
    """The start and end tags of ``names`` in XML files: __f file, __b block of it, __i place in the block, name,
    end (an end tag), empty (a tag of an element without content), text. A file is read by blocks."""
    lines = spark.read.option("lineSep", ">").text(path)
    tag = F.regexp_extract("value", r"<[^<]*$", 0)
    rows = lines.select(
        F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__i"), tag.alias("text")
    )
    rows = rows.withColumn("name", F.regexp_extract("text", r"^</?([A-Za-z0-9_.:-]+)", 1))
    return rows.where(F.col("name").rlike(f"^(?:{names})$")).withColumn("end", F.col("text").startswith("</")).withColumn("empty", F.col("text").endswith("/"))


def read_lineage_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Frame rows (field, cell, colour, type, timeframe, x, y, status) of cells nested to any depth, and
    divisions (field, mother, daughters): a row for each cell with a nested list, whose daughters are those of all
    its lists if the first holds exactly two cells, and none otherwise.

    Files are streams of tags, cut into blocks: how many cells are open at a tag, and which cell is the innermost
    one, comes from running values inside blocks and from what earlier blocks of the file leave open, so neither
    a deep tree nor a long file is one task. Attribute values and comments must not hold a '>'.
    """
    t = Rounds(spark)
    attr = lambda k: F.nullif(F.regexp_extract("text", rf"""[\s"']{k}\s*=\s*["']([^"']*)["']""", 1), F.lit(""))
    tags = t.write(_tags(spark, path, "f|as|a|s"), "tags")
    block, place = Window.partitionBy("__f", "__b"), Window.partitionBy("__f", "__b").orderBy("__i")
    step = F.when((F.col("name") != "a") | F.col("empty"), 0).when(F.col("end"), -1).otherwise(1)
    # how many cells are open when a block starts: one row a block
    starts = tags.groupBy("__f", "__b").agg(F.sum(step).alias("__n"))
    starts = starts.select("__f", "__b", F.coalesce(F.sum("__n").over(Window.partitionBy("__f").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__n"))
    here = tags.withColumn("__d", F.coalesce(F.sum(step).over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).join(starts, ["__f", "__b"])
    opens = (F.col("name") == "a") & ~F.col("end")
    here = here.where("NOT end").withColumn("depth", F.col("__d") + F.col("__n") + opens.cast("int"))
    # a place is kept as (block, place in it); an element is found by the last one of its kind and depth before
    at = F.struct("__b", "__i")
    here = here.select("__f", "__b", "__i", "name", "depth", "text", at.alias("at"))
    kinds = {
        "cell": (F.col("name") == "a", F.struct("at", attr("id").cast("long").alias("id"), attr("brush").alias("colour"), attr("type").alias("type"))),
        "list": (F.col("name") == "as", F.struct("at", F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("colour"), F.lit(None).cast("string").alias("type"))),
        "field": (F.col("name") == "f", F.struct("at", attr("id").cast("long").alias("id"), F.lit(None).cast("string").alias("colour"), F.lit(None).cast("string").alias("type"))),
    }
    kind = F.when(kinds["cell"][0], "cell").when(kinds["list"][0], "list").when(kinds["field"][0], "field")
    element = F.when(kinds["cell"][0], kinds["cell"][1]).when(kinds["list"][0], kinds["list"][1]).otherwise(kinds["field"][1])
    level = F.when(F.col("name") == "f", -1).otherwise(F.col("depth"))
    here = t.write(here.withColumn("kind", kind).withColumn("element", F.when(kind.isNotNull(), element)).withColumn("level", level), "here")

    # what each kind and level was last in a block, and so far in the file: rows of blocks times levels
    last = here.where("kind IS NOT NULL").groupBy("__f", "__b", "kind", "level").agg(F.max_by("element", "__i").alias("element"))
    blocks = here.select("__f", "__b").distinct()
    grid = blocks.join(last.select("__f", "kind", "level").distinct(), "__f").join(last, ["__f", "__b", "kind", "level"], "left")
    before = Window.partitionBy("__f", "kind", "level").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = t.write(grid.withColumn("carried", F.last("element", ignorenulls=True).over(before)).where("carried IS NOT NULL").drop("element"), "carried")

    def innermost(rows: DataFrame, kind: str, level: Column, name: str) -> DataFrame:
        """rows of ``here`` with the element of a kind and level that was last opened before them."""
        both = rows.select("*", level.alias("want"), F.lit(None).cast(here.schema["element"].dataType).alias("own")).unionByName(
            here.where(F.col("kind") == kind).select("__f", "__b", "__i", F.col("level").alias("want"), F.col("element").alias("own")), allowMissingColumns=True
        )
        inside = F.last("own", ignorenulls=True).over(Window.partitionBy("__f", "__b", "want").orderBy("__i", F.col("own").isNotNull()).rowsBetween(Window.unboundedPreceding, -1))
        found = both.withColumn("found", inside).where("own IS NULL").drop("own")
        c = carried.where(F.col("kind") == kind).select("__f", "__b", F.col("level").alias("want"), "carried")
        return found.join(c, ["__f", "__b", "want"], "left").withColumn(name, F.coalesce("found", "carried")).drop("want", "found", "carried")

    d = F.col("depth")
    s = innermost(here.where("name = 's' AND depth > 0"), "cell", d, "cell")
    s = innermost(s, "field", F.lit(-1).cast("int"), "field")
    frames = s.select(
        F.col("field.id").alias("field"), F.col("cell.id").alias("cell"), F.col("cell.colour").alias("colour"), F.col("cell.type").alias("type"),
        attr("i").cast("int").alias("timeframe"), attr("x").cast("double").alias("x"), attr("y").cast("double").alias("y"), attr("s").cast("int").alias("status"),
    )
    lists = innermost(here.where("name = 'as' AND depth > 0"), "cell", d, "cell")
    lists = innermost(lists, "field", F.lit(-1).cast("int"), "field")
    firsts = lists.groupBy("__f", F.col("cell.at").alias("mother_at")).agg(
        F.first("cell.id").alias("mother"), F.first("field.id").alias("field"), F.min("at").alias("first_list")
    )
    inner = innermost(here.where("name = 'a' AND depth > 1"), "cell", d - 1, "cell")
    inner = innermost(inner, "list", d - 1, "list")
    inner = inner.select("__f", F.col("cell.at").alias("mother_at"), F.col("list.at").alias("list_at"), F.col("element.id").alias("daughter"), "at")
    both = firsts.join(inner, ["__f", "mother_at"], "left").groupBy("__f", "mother_at", "mother", "field").agg(
        F.count(F.when(F.col("list_at") == F.col("first_list"), 1)).alias("n"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("daughter").isNotNull(), F.struct("at", "daughter")))), lambda x: x["daughter"]).alias("daughters"),
    )
    return frames, both.select("field", "mother", F.when(F.col("n") == 2, F.col("daughters")).otherwise(F.array().cast("array<bigint>")).alias("daughters"))


def read_class_clips(spark: SparkSession, folder: str, classes: list[str] | None = None) -> DataFrame:
    """Clips of <folder>/<class>/<clip>: cells with class, clip file and source folder; empty clips have
    no rows."""
    c = spark.read.schema(CELLS).option("recursiveFileLookup", True).json(folder).withColumn("__p", F.col(PATH))
    c = c.withColumn("class", F.regexp_replace(F.regexp_extract("__p", r"([^/]+)/[^/]+$", 1), "^class=", "")).withColumn("sample_id", F.regexp_extract("__p", r"([^/]+)$", 1)).withColumn("src_dir", F.lit(folder)).drop("__p")
    return c if classes is None else c.where(F.col("class").isin(classes))


def write_class_clips(clips: DataFrame, folder: str) -> None:
    """Clips by class."""
    clips.write.mode("overwrite").partitionBy("class").json(folder)


# -- tables of text -------------------------------------------------------------------------------


def read_csv_manifests(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """<folder>/<subdir>/*.csv with their sub-directory."""
    c = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).csv(folder)
    return c.withColumn("subdir", F.regexp_extract(PATH, r"([^/]+)/[^/]+$", 1))


def read_experiment_logs(spark: SparkSession, folder: str, schema: str, kind: str = "iteration_metrics") -> DataFrame:
    """<folder>/<strategy>_run<id>[_...]/ctc_seg_*/*<kind>*, at that depth only, with strategy and run."""
    c = spark.read.schema(schema).option("header", True).option("pathGlobFilter", f"*{kind}*").csv(f"{folder}/*_run*/ctc_seg_*")
    part = lambda k: F.regexp_extract(PATH, r"/([^/]+?)_run(\d+)[^/]*/ctc_seg_[^/]*/[^/]+$", k)
    return c.withColumn("strategy_name", part(1)).withColumn("run_id", part(2).cast("int"))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines of path and label."""
    return spark.read.schema("path STRING, label INT").option("sep", " ").csv(path)


def write_list(rows: DataFrame, path: str) -> None:
    """S14."""
    rows.select("path", "label").write.mode("overwrite").option("sep", " ").csv(path)
