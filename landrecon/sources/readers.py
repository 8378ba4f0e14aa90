"""Readers that turn files and tables into features."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from landrecon.functions import geo, kernel, scalar
from landrecon.functions.columns import once
from landrecon.operators import grid, skew
from landrecon.operators.rounds import Rounds
from landrecon.settings import CANONICAL_TYPE, DEFAULT_CANONICAL_TYPE, DEFAULTS, Settings
from landrecon.sources import checksums, geojson

RAW = ["ordinal", "properties", "geometry_geojson"]
FEATURE = ["feature_id", "dataset_id", "source_type", "canonical_type", "ordinal", "properties", "geom",
           "kind", *grid.BOX, "centroid_lon", "centroid_lat", "area_sqm", "is_valid"]


def canonical_type(source_type: Column) -> Column:
    out = F.lit(DEFAULT_CANONICAL_TYPE)
    for source, kind in CANONICAL_TYPE.items():
        out = F.when(source_type == source, kind).otherwise(out)
    return out


def as_features(raw: DataFrame, dataset_id: Column | str, source_type: Column | str,
                crs: Column | str | None = None, cfg: Settings = DEFAULTS) -> DataFrame:
    """Typed, reprojected and measured features of one or several datasets.

    ``raw`` has ``ordinal``, ``properties`` and ``geometry_geojson``. Rows whose geometry cannot be
    read are dropped. A dataset without a usable declared CRS is judged by its first feature.
    """
    def column(v: Column | str | None) -> Column:
        return v if isinstance(v, Column) else F.lit(v).cast("string")

    tagged = raw.withColumns({"dataset_id": column(dataset_id), "source_type": column(source_type), "_declared": column(crs)})
    parsed = once(tagged, _g=geo.parse_geojson(F.col("geometry_geojson")))
    first = parsed.groupBy("dataset_id").agg(
        F.min_by(F.struct("_declared", "_g"), F.col("ordinal")).alias("f")).select(
        "dataset_id", "f._declared", geo.centroid(F.col("f._g")).alias("c"))
    source = first.select("dataset_id", geo.detect_crs(F.col("_declared"), F.col("c.x"), F.col("c.y")).alias("_crs"))
    joined = skew.lookup_join(parsed.where(F.col("_g").isNotNull()), source, ["dataset_id"], F.col("ordinal"))
    moved = once(joined, _m=geo.reproject(F.col("_g"), F.col("_crs"), F.lit(f"EPSG:{cfg.target_epsg}")))
    shaped = moved.withColumns({"geom": F.col("_m.geom"), "canonical_type": canonical_type(F.col("source_type"))})
    return with_measures(shaped).select(*FEATURE)


def with_measures(df: DataFrame) -> DataFrame:
    """Bounding box, centroid, area and validity of ``geom``."""
    g = F.col("geom")
    out = once(df, _box=geo.bbox(g), _mid=geo.centroid(g))
    if "feature_id" not in df.columns:
        out = out.withColumn("feature_id", scalar.natural_id("FT", F.col("dataset_id"), F.col("ordinal")))
    return out.withColumns({
        "kind": g["kind"], **{c: F.col("_box")[c] for c in grid.BOX},
        "centroid_lon": F.col("_mid.x"), "centroid_lat": F.col("_mid.y"),
        "area_sqm": F.when(geo.is_polygonal(g), geo.area_sqm(g)),
        "is_valid": F.coalesce(kernel.validity_of(g) == "ok", g.isNotNull())})


def read_geojson(spark: SparkSession, path: str, dataset_id: Column | str, source_type: Column | str,
                 crs: str | None = None, cfg: Settings = DEFAULTS) -> DataFrame:
    """FeatureCollection files, or files with one feature per line, split by byte ranges (see ``geojson``).

    Each file of a folder is read by what it holds. Anything that is neither raises. Features that
    cannot be read are dropped one by one. Dataset and source may be columns over ``file``, the path of a feature's file.
    """
    items = geojson.feature_texts(spark, path).withColumn("f", F.from_json("value", "struct<geometry:string,properties:string>"))
    raw = items.select("file", "ordinal", "hint", F.col("f.geometry").alias("geometry_geojson"),
                       F.coalesce(F.from_json("f.properties", "map<string,string>"),
                                  F.create_map().cast("map<string,string>")).alias("properties"))
    return as_features(raw, dataset_id, source_type, F.coalesce(F.lit(crs), F.col("hint")), cfg)


def csv_points(rows: DataFrame, lat: str = "latitude", lon: str = "longitude", ordinal: Column | None = None) -> DataFrame:
    """Point rows of a table: unreadable and out-of-range positions are dropped, the rest is the bag."""
    y, x = F.col(lat).cast("string").try_cast("double"), F.col(lon).cast("string").try_cast("double")
    others = [c for c in rows.columns if c not in (lat, lon)]
    bag = F.map_from_arrays(F.array(*[F.lit(c) for c in others]),
                            F.array(*[F.col(c).cast("string") for c in others]))
    out = rows.withColumns({"_y": y, "_x": x})
    good = F.col("_y").between(-90, 90) & F.col("_x").between(-180, 180)
    return out.where(F.coalesce(good, F.lit(False)) & ~F.isnan("_x") & ~F.isnan("_y")).select(
        (F.monotonically_increasing_id() if ordinal is None else ordinal).alias("ordinal"), bag.alias("properties"),
        F.col("_x").alias("x"), F.col("_y").alias("y"))


def read_csv_points(spark: SparkSession, path: str, dataset_id: str, source_type: str, lat: str = "latitude",
                    lon: str = "longitude", cfg: Settings = DEFAULTS) -> DataFrame:
    rows = spark.read.csv(path, header=True)
    if lat not in rows.columns or lon not in rows.columns:
        rows = rows.withColumns({c: F.lit(None).cast("string") for c in (lat, lon) if c not in rows.columns})
    pts = csv_points(rows, lat, lon)
    raw = pts.withColumn("geometry_geojson", geo.to_geojson(geo.point_geom(F.col("x"), F.col("y"))))
    return as_features(raw.select(*RAW), dataset_id, source_type, "EPSG:4326", cfg)


_COORDINATES = "coordinates array<string>"
_RING = f"array<struct<LinearRing:array<struct<{_COORDINATES.replace(' ', ':')}>>>>"
_POLYGON = f"array<struct<outerBoundaryIs:{_RING}>>"
_LINE = "array<struct<coordinates:array<string>>>"
KML_SCHEMA = (
    "name array<string>, ExtendedData array<struct<"
    "SchemaData:array<struct<SimpleData:array<struct<_name:string,_VALUE:string>>>>,"
    "Data:array<struct<_name:string,value:array<string>>>>>, "
    f"Polygon {_POLYGON}, LineString {_LINE}, Point {_LINE}, "
    f"MultiGeometry array<struct<Polygon:{_POLYGON},LineString:{_LINE},Point:{_LINE}>>"
)


def _positions(text: Column) -> Column:
    """``lon,lat[,alt]`` tokens of a KML coordinate text; unreadable ones are skipped."""
    tokens = F.transform(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda t: F.split(t, ","))
    pairs = F.transform(tokens, lambda t: F.struct(
        F.get(t, F.lit(0)).try_cast("double").alias("x"), F.get(t, F.lit(1)).try_cast("double").alias("y")))
    return F.filter(pairs, lambda p: p["x"].isNotNull() & p["y"].isNotNull())


def kml_features(placemarks: DataFrame) -> DataFrame:
    """``properties`` and ``geom`` of parsed placemarks (see ``KML_SCHEMA``)."""
    def nested(column: str) -> Column:
        own = F.coalesce(F.col(column), F.array())
        inside = F.flatten(F.transform(F.coalesce("MultiGeometry", F.array()), lambda m: F.coalesce(m[column], F.array())))
        return F.concat(own, inside)

    def flat(items: Column, f) -> Column:
        return F.flatten(F.transform(F.coalesce(items, F.array()), f))

    data = flat(F.col("ExtendedData"), lambda e: F.concat(
        flat(e["SchemaData"], lambda s: F.transform(F.coalesce(s["SimpleData"], F.array()), lambda d: F.struct(
            d["_name"].alias("k"), F.coalesce(F.trim(d["_VALUE"]), F.lit("")).alias("v")))),
        F.transform(F.coalesce(e["Data"], F.array()), lambda d: F.struct(
            d["_name"].alias("k"), F.coalesce(F.trim(F.get(d["value"], F.lit(0))), F.lit("")).alias("v")))))
    df = placemarks.withColumns({"_p": nested("Polygon"), "_l": nested("LineString"), "_t": nested("Point"),
                                 "_d": F.filter(data, lambda d: d["k"].isNotNull())})
    last = F.filter("_d", lambda d, i: ~F.exists(
        F.slice("_d", i + 2, F.greatest(F.size("_d") - i - 1, F.lit(0))), lambda o: o["k"] == d["k"]))
    bag = F.map_from_entries(last)
    title = F.trim(F.get("name", F.lit(0)))
    bag = F.when(title.isNotNull() & (title != "") & ~F.array_contains(F.map_keys(bag), "name"),
                 F.map_concat(F.create_map(F.lit("name"), title), bag)).otherwise(bag)

    def first_text(items: Column) -> Column:
        return F.get(F.get(items, F.lit(0))["coordinates"], F.lit(0))

    def outer(p: Column) -> Column:
        ring = F.get(F.get(p["outerBoundaryIs"], F.lit(0))["LinearRing"], F.lit(0))
        return _positions(F.get(ring["coordinates"], F.lit(0)))

    rings = F.filter(F.transform("_p", outer), lambda r: F.size(r) >= 4)
    closed = F.transform(rings, lambda r: F.when(r[0] == F.element_at(r, -1), r).otherwise(
        F.concat(r, F.array(r[0]))))
    line, point = _positions(first_text(F.col("_l"))), _positions(first_text(F.col("_t")))

    def shape(kind: str, parts: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), parts.cast(geo.PARTS).alias("parts"))

    geom = (F.when(F.size("_r") == 1, shape("Polygon", F.array(F.array(F.col("_r")[0]))))
            .when(F.size("_r") > 1, shape("MultiPolygon", F.transform("_r", lambda r: F.array(r))))
            .when(F.size("_l") > 0, F.when(F.size("_line") >= 2, shape("LineString", F.array(F.array("_line")))))
            .when(F.size("_point") > 0, shape("Point", F.array(F.array(F.slice("_point", 1, 1))))))
    out = df.withColumns({"_r": closed, "_line": line, "_point": point, "properties": bag}).withColumn("geom", geom)
    return out.where(F.col("geom").isNotNull())


def read_kml(spark: SparkSession, path: str, dataset_id: str, source_type: str) -> DataFrame:
    """KML placemarks, or the first KML document of each KMZ archive. Raises when none is usable."""
    if path.lower().endswith(".kmz"):
        placemarks = _kmz_placemarks(spark, path)
    else:
        placemarks = (spark.read.format("xml").option("rowTag", "Placemark").option("ignoreNamespace", "true")
                      .schema(KML_SCHEMA).load(path))
    feats = kml_features(placemarks).withColumns({
        "ordinal": F.monotonically_increasing_id(), "dataset_id": F.lit(dataset_id),
        "source_type": F.lit(source_type), "canonical_type": canonical_type(F.lit(source_type))})
    if feats.isEmpty():
        raise ValueError("no supported Point, LineString or Polygon features found in KML/KMZ")
    return with_measures(feats).select(*FEATURE)


def _kmz_placemarks(spark: SparkSession, path: str) -> DataFrame:
    def unzip(batches):
        for pdf in batches:
            texts = []
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = [n for n in z.namelist() if n.lower().endswith(".kml")]
                    if not names:
                        raise ValueError("KMZ does not contain a KML document")
                    texts.append(z.read(names[0]).decode("utf-8"))
            yield pd.DataFrame({"kml": texts})

    docs = spark.read.format("binaryFile").load(path).select("content").mapInPandas(unzip, "kml string")
    marks = docs.select(F.explode(F.regexp_extract_all("kml", F.lit(r"(?s)(<(?:\w+:)?Placemark\b.*?</(?:\w+:)?Placemark>)"), 1)).alias("x"))
    # Prefixes carry no meaning here and would not match the schema.
    bare = F.regexp_replace("x", r"(</?)\w+:", "$1")
    return marks.select(F.from_xml(bare, KML_SCHEMA, {"mode": "PERMISSIVE"}).alias("p")).select("p.*")


# --- raster tables ------------------------------------------------------------------------

def raster_footprint(meta: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Bounds ``(left, bottom, right, top, crs)`` of rasters as polygons in the target CRS."""
    box = geo.box_geom(F.col("left"), F.col("bottom"), F.col("right"), F.col("top"))
    moved = once(meta, _m=geo.reproject(box, F.col("crs"), F.lit(f"EPSG:{cfg.target_epsg}")))
    out = moved.withColumns({"geom": F.col("_m.geom"), "status": F.col("_m.status")})
    out = once(out, _mid=geo.centroid(F.col("geom")))
    return out.withColumns({"centroid_lon": F.col("_mid.x"), "centroid_lat": F.col("_mid.y"),
                            "area_sqm": geo.area_sqm(F.col("geom"))}).drop("_m", "_mid")


def raster_band_stats(pixels: DataFrame) -> DataFrame:
    """Valid pixels of the first band per raster: count, extremes and mean."""
    valid = pixels.where((F.col("band") == 1) & F.col("value").isNotNull()
                         & (F.col("nodata").isNull() | (F.col("value") != F.col("nodata"))))
    found = valid.groupBy("raster_id").agg(
        F.count(F.lit(1)).alias("valid_pixels"), F.min("value").alias("sample_min"),
        F.max("value").alias("sample_max"), F.round(F.avg("value"), 4).alias("sample_mean"))
    every = pixels.select("raster_id").distinct()
    return every.join(found, "raster_id", "left").withColumn("valid_pixels", F.coalesce("valid_pixels", F.lit(0)))


def raster_tile_grid(rasters: DataFrame, tile_size: int = 768, overlap: int = 96) -> DataFrame:
    """Overlapping tiles of each raster ``(raster_id, width, height)``, cut at the far edges."""
    tile = max(256, min(tile_size, 1536))
    step = tile - max(0, min(overlap, tile // 4))
    tops = rasters.withColumn("top", F.explode(F.sequence(F.lit(0), F.col("height") - 1, F.lit(step))))
    tiles = tops.withColumn("left", F.explode(F.sequence(F.lit(0), F.col("width") - 1, F.lit(step))))
    return tiles.select("raster_id", "left", "top", F.least(F.lit(tile), F.col("width") - F.col("left")).alias("tile_width"),
                        F.least(F.lit(tile), F.col("height") - F.col("top")).alias("tile_height"))


def exact_quantiles(values: DataFrame, keys: list[str], value: str, probs: tuple[float, ...],
                    buckets: int = 4096) -> DataFrame:
    """Linearly interpolated quantiles per key as an array ``q``, without one task per key.

    Values are counted first. Equal-width buckets locate the wanted ranks, and only the distinct
    values of the buckets that hold one are put in order. Counted and placed values are read several times, so each is kept:
    they are made once, and no task holds the hash tables and sorts of all these steps together.
    """
    rounds = Rounds(values.sparkSession)
    counts = rounds.keep(values.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n")))
    span = rounds.keep(counts.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_n").alias("_all")))
    place = F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * buckets)
    bucket = F.when(F.col("_hi") > F.col("_lo"), F.least(place, F.lit(buckets - 1))).otherwise(F.lit(0)).cast("int")
    placed = rounds.keep(skew.lookup_join(counts, span, keys, F.col("_v")).select(*keys, "_v", "_n", bucket.alias("_b")))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(*keys, "_b").agg(F.sum("_n").alias("_m")).withColumn(
        "_start", F.coalesce(F.sum("_m").over(before), F.lit(0)))
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), f(p * (F.col("_all") - 1)).alias("r"), F.lit(up).alias("up"))
                      for i, p in enumerate(probs) for up, f in ((0, F.floor), (1, F.ceil))])
    wanted = rounds.keep(span.select(*keys, F.inline(ranks)).join(sizes, keys).where(
        (F.col("r") >= F.col("_start")) & (F.col("r") < F.col("_start") + F.col("_m"))))
    need = wanted.select(*keys, "_b").distinct()
    upto = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = placed.join(need, keys + ["_b"], "left_semi").withColumn("_cum", F.sum("_n").over(upto))
    found = wanted.join(ordered, keys + ["_b"]).where(
        (F.col("r") - F.col("_start") < F.col("_cum")) & (F.col("r") - F.col("_start") >= F.col("_cum") - F.col("_n")))
    ends = found.groupBy(*keys, "i").agg(F.max(F.when(F.col("up") == 0, F.col("_v"))).alias("_v0"),
                                         F.max(F.when(F.col("up") == 1, F.col("_v"))).alias("_v1"))
    share = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("i") + 1) * (F.col("_all") - 1)
    value_at = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (share - F.floor(share))
    out = ends.join(span.select(*keys, "_all"), keys)
    return out.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", value_at.alias("v")))).alias("_q")).select(
        *keys, F.transform("_q", lambda e: e["v"]).alias("q"))


def percentile_stretch(pixels: DataFrame) -> DataFrame:
    """Band values stretched to 0..255 between their 2nd and 98th percentiles.

    The band limits are one row per raster and band, looked up by the pixels.
    """
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf"))
    limits = exact_quantiles(pixels.where(finite), ["raster_id", "band"], "value", (0.02, 0.98))
    limits = limits.select("raster_id", "band", F.col("q")[0].alias("_low"),
                           F.when(F.col("q")[1] <= F.col("q")[0], F.col("q")[0] + 1).otherwise(F.col("q")[1]).alias("_high"))
    limits = Rounds(pixels.sparkSession).keep(limits)  # counted, then joined
    joined = skew.lookup_join(pixels, limits, ["raster_id", "band"], F.col("value"), "left")
    scaled = (F.col("value") - F.col("_low")) * (255.0 / (F.col("_high") - F.col("_low")))
    level = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), scaled))).cast("int")
    return joined.withColumn("level", F.when(finite, level).otherwise(F.lit(0))).drop("_low", "_high")


# --- documents ----------------------------------------------------------------------------

# What identifiers look like in scanned land-record documents.
DOCUMENT_PATTERNS = {
    "survey_number": r"(?:survey|gat|cts)\s*(?:no\.?|number)?\s*[:#-]?\s*([A-Za-z0-9/-]+)",
    "khata_number": r"(?:khata)\s*(?:no\.?|number)?\s*[:#-]?\s*([A-Za-z0-9/-]+)",
    "area_text": r"(?:area|क्षेत्र)\s*[:#-]?\s*([0-9.,]+\s*(?:ha|hectare|acre|sq\.?\s*m)?)",
}
PREVIEW_CHARS = 3000


def extract_document_fields(docs: DataFrame, text: str = "text", patterns: dict[str, str] | None = None) -> DataFrame:
    """First match of each pattern in the whole text, and the start of the text for reviewers."""
    found = {k: F.trim(F.nullif(F.regexp_extract(text, "(?i)" + p, 1), F.lit("")))
             for k, p in (patterns or DOCUMENT_PATTERNS).items()}
    return docs.withColumns({**found, "text_preview": F.substring(text, 1, PREVIEW_CHARS)})


def file_checksums(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Path, length and SHA-256 of each file; no task holds a whole file (see ``checksums``)."""
    options = {"recursiveFileLookup": str(recursive).lower()}
    files = spark.read.format("binaryFile").options(**options).load(path).select(
        F.col("_metadata.file_path").alias("file"), "path", "length")
    return files.join(checksums.file_digests(spark, files, path, options), "file").select("path", "length", "sha256")


def sync_geometry_columns(df: DataFrame) -> DataFrame:
    """Typed geometry and box from GeoJSON text; blank text gives null."""
    return df.withColumn("geom", geo.parse_geojson(F.nullif(F.col("geometry_geojson"), F.lit("")))).withColumn(
        "bbox", F.when(F.col("geom").isNotNull(), geo.bbox(F.col("geom"))))

