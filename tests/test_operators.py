"""Topology, conflicts, mappings, changes, contracts and reports on small hand-made data."""

from dataclasses import replace
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from landrecon.functions import scalar, text
from landrecon.operators import changes, conflicts, contracts, grid, mapping, match, skew, stats, topology
from landrecon.plans.harmonize import harmonize
from landrecon.settings import CANONICAL_SYNONYMS, Settings
from tests.shapes import PLANE, datasets, layer

BOX = (74.2, 16.7, 74.2006, 16.7006)


def parcel(i, box, tag="c", kind="Polygon", source="cadastral", canonical="parcel", owner="ann", use="farm", key=None):
    return (f"{tag}@{i}", source, canonical, i, kind, *box, owner, use, key or f"P-{i}")


def iou(a, b):
    w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
    size = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return w * h / (size(a) + size(b) - w * h)


@pytest.mark.parametrize("hot_rows", [50_000, 2])
def test_copies_count_like_all_pairs(spark, hot_rows):
    """Interleaved stacks of copies: per-feature counts equal counting every pair."""
    near = (74.20001, 16.70001, 74.20061, 16.70061)
    half = (74.2003, 16.7, 74.2009, 16.7006)
    boxes = [BOX, half, BOX, near, half, BOX, near, half]
    features = layer(spark, [parcel(i, b) for i, b in enumerate(boxes)])
    cfg = replace(PLANE, hot_rows=hot_rows, duplicate_iou=0.9)
    for run, keep in ((topology.duplicate_geometries, lambda v: v > 0.9),
                      (topology.overlapping_geometries, lambda v: 0.05 < v <= 0.9)):
        want = {}
        for j in range(len(boxes)):
            for i in range(j):
                if keep(iou(boxes[i], boxes[j])):
                    want[f"c@{j}"] = want.get(f"c@{j}", 0) + 1
        got = {r.feature_id: r.n for r in run(features, cfg).groupBy("feature_id").agg(F.sum("pair_count").alias("n")).collect()}
        assert got == want
    later = conflicts.parcel_overlap_conflicts(features, replace(cfg, duplicate_iou=0.9)).agg(F.sum("pair_count")).first()[0]
    assert later == sum(1 for j in range(8) for i in range(j) if 0.05 < iou(boxes[i], boxes[j]) < 0.9)


def test_running_sum_over_blocks(spark):
    df = spark.range(0, 300_000, 7).withColumn("g", F.col("id") % 3)
    out = skew.running_position(df, ["g"], "id", "n")
    bad = out.withColumn("w", F.expr("row_number() over (partition by g order by id)")).where("n <> w")
    assert bad.isEmpty()


def test_salted_join_equals_plain_join(spark):
    many = spark.range(1000).select(F.when(F.col("id") < 700, 0).otherwise(F.col("id")).alias("k"), "id")
    few = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    a, b = skew.salted(many, few, ["k"], F.col("id"), 50)
    assert a.select("_salt").distinct().count() > 5
    got = a.join(b, ["k", "_salt"]).select("id", "v")
    assert got.exceptAll(many.join(few, "k").select("id", "v")).isEmpty() and got.count() == 1000
    assert skew.lookup_join(many, few, ["k"], F.col("id"), max_rows=10, hot_rows=50).count() == 1000


@pytest.mark.parametrize("max_cells", [None, 4])
def test_grid_join_equals_cross_join(spark, max_cells):
    import random
    rnd = random.Random(3)

    def some(p, n):
        rows = []
        for i in range(n):
            x, y, w = rnd.uniform(-1, 1), rnd.uniform(-1, 1), rnd.choice([0, 0.01, 0.5, 1.7])
            rows.append((i, x, y, x + w, y + w / 2))
        return spark.createDataFrame(rows, ", ".join(f"{p}{c} {t}" for c, t in (
            ("ordinal", "long"), ("xmin", "double"), ("ymin", "double"), ("xmax", "double"), ("ymax", "double"))))

    a, b = some("a_", 40), some("b_", 50)
    pad = F.lit(0.02)
    got = grid.box_pairs(a, b, 0.1, pad_x=pad, pad_y=pad, hot_rows=5, max_cells=max_cells).select("a_ordinal", "b_ordinal")
    want = a.join(b, (F.col("a_xmin") - pad <= F.col("b_xmax")) & (F.col("a_xmax") + pad >= F.col("b_xmin"))
                  & (F.col("a_ymin") - pad <= F.col("b_ymax")) & (F.col("a_ymax") + pad >= F.col("b_ymin"))).select("a_ordinal", "b_ordinal")
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_layer_wide_boxes_add_a_row_for_each_level(spark):
    """Boxes of eight sizes up to 30 degrees: few rows are listed, and the pairs are those of a cross join."""
    import random
    rnd = random.Random(8)

    def some(p, n):
        rows = []
        for i in range(n):
            w = rnd.choice([0, 0.0005, 0.003, 0.02, 0.1, 1.0, 7.0, 30.0])
            x, y = rnd.uniform(70, 76), rnd.uniform(10, 16)
            rows.append((i, i % 2, x, y, x + w, y + w * rnd.choice([0, 1])))
        return spark.createDataFrame(rows, ", ".join(f"{p}{c} {t}" for c, t in (
            ("ordinal", "long"), ("k", "int"), ("xmin", "double"), ("ymin", "double"), ("xmax", "double"), ("ymax", "double"))))

    a, b = some("a_", 120), some("b_", 150)
    pad, cell = F.lit(0.001), 0.004
    got = grid.box_pairs(a, b, cell, pad_x=pad, pad_y=pad, on=("k",), hot_rows=20, max_cells=16).select("a_ordinal", "b_ordinal")
    want = a.join(b, (F.col("a_k") == F.col("b_k")) & (F.col("a_xmin") - pad <= F.col("b_xmax")) & (F.col("a_xmax") + pad >= F.col("b_xmin"))
                  & (F.col("a_ymin") - pad <= F.col("b_ymax")) & (F.col("a_ymax") + pad >= F.col("b_ymin"))).select("a_ordinal", "b_ordinal")
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()
    every = F.array(*[F.lit(n) for n in grid._present(a, b, cell, 16)])
    rows = grid.listed(b, "b_", cell, None, None, F.filter(every, lambda n: n >= grid.level_of("b_", cell, 16)))
    assert rows.groupBy("b_ordinal", "_level").count().agg(F.max("count")).first()[0] <= 16
    assert rows.count() <= 16 * 150 * len(grid._present(a, b, cell, 16))


@pytest.mark.parametrize("wide", [False, True])
def test_conflicts_with_a_layer_wide_parcel(spark, wide):
    """A parcel of 2 by 2 degrees next to small ones: the same findings from the plain grid and from the hierarchy."""
    from dataclasses import replace

    from landrecon import lens
    from landrecon.operators import conflicts

    box = lambda x, y, w: [tuple(map(float, (x, y, x + w, y + w)))]
    rows = [(i, t, *b) for i, (t, (b,)) in enumerate(
        [("parcel", box(74, 16, 2.0)), ("parcel", box(74.1, 16.1, 0.001)), ("parcel", box(74.1005, 16.1, 0.001)),
         ("building", box(75.9999, 17.9999, 0.0003)), ("building", box(74.1008, 16.1003, 0.0004)),
         ("gnss_point", box(76.2, 18.2, 0)), ("gnss_point", box(75.0, 17.0, 0))])]
    made = spark.createDataFrame(rows, "ordinal long, canonical_type string, xmin double, ymin double, xmax double, ymax double")
    made = made.withColumns({"feature_id": F.concat(F.lit("F"), "ordinal"), "dataset_id": F.col("canonical_type"), "source_type": F.lit("cadastral"),
                             "kind": F.when(F.col("canonical_type") == "gnss_point", "Point").otherwise("Polygon"),
                             "properties": F.create_map().cast("map<string,string>")})
    made = lens.measured(made, lens.LENS, mapped=False)
    cfg = replace(lens.LENS, same_layer_cell_deg=0.01, oversize_cells=16 if wide else 10**9)
    found = [d(made, cfg) for d in (conflicts.parcel_overlap_conflicts, conflicts.building_crossing_conflicts, conflicts.gnss_outside_conflicts)]
    got = sorted((r.conflict_type, r.feature_ref) for df in found for r in df.collect())
    assert got == [("building_boundary_crossing", "F4"), ("gnss_outside_parcel", "F5"), ("parcel_overlap", "F1")]


def test_validation_keeps_the_first_original(spark):
    bow = '{"type":"Polygon","coordinates":[[[0,0],[2,2],[0,2],[2,0],[0,0]]]}'
    raw = spark.createDataFrame([(0, {}, bow)], "ordinal long, properties map<string,string>, geometry_geojson string")
    from landrecon.sources.readers import as_features

    cfg = Settings()
    one, rows = topology.topology_validation(as_features(raw, "DS", "cadastral", "EPSG:4326"), None, cfg)
    first = rows.first()
    assert first.issue_type == "self_intersection" and first.corrected and not first.is_valid
    assert first.original_geometry != first.corrected_geometry
    fixed = one.first()
    assert fixed.kind == "MultiPolygon" and fixed.is_valid
    again = topology.topology_validation(one, rows.withColumn("position", F.lit(1)), cfg)[1].first()
    assert again.original_geometry == first.original_geometry and again.corrected and again.issue_type == "self_intersection"


def test_dedupe_footprints_is_sequential(spark):
    step = 0.00008
    boxes = [(74.2 + i * step, 16.7, 74.2006 + i * step, 16.7006) for i in range(7)] + [(75.0, 16.7, 75.0006, 16.7006)] * 2
    kept = []
    for i, b in enumerate(boxes):
        if all(iou(boxes[k], b) < 0.7 for k in kept):
            kept.append(i)
    features = layer(spark, [parcel(i, b) for i, b in enumerate(boxes)])
    for cfg in (PLANE, Settings()):
        out = topology.dedupe_footprints(features, replace(cfg, footprint_iou=0.7))
        assert {r.ordinal for r in out.collect()} == set(kept)


def test_survey_points_and_lines(spark):
    rows = [parcel(0, BOX), parcel(0, (74.2003, 16.7003, 74.2003, 16.7003), "g", "Point", "gnss", "gnss_point"),
            parcel(1, (74.22, 16.7, 74.22, 16.7), "g", "Point", "gnss", "gnss_point"),
            parcel(2, (74.2015, 16.7003, 74.2015, 16.7003), "g", "Point", "gnss", "gnss_point"),
            parcel(0, (74.2001, 16.7003, 74.2004, 16.7003), "u", "LineString", "utility", "utility"),
            parcel(1, (74.2001, 16.7003, 74.21, 16.7003), "u", "LineString", "utility", "utility")]
    for cfg in (PLANE, Settings()):
        features = layer(spark, rows, cfg)
        far = {r.feature_ref: r.confidence for r in conflicts.gnss_outside_conflicts(features, cfg).collect()}
        assert set(far) == {"g@1", "g@2"} and far["g@1"] == 0 and 10 < far["g@2"] < 20
        assert [r.feature_ref for r in conflicts.utility_crossing_conflicts(features, cfg).collect()] == ["u@1"]


def test_ratio_is_the_matching_block_ratio(spark):
    pairs = [("tide", "diet"), ("diet", "tide"), ("a", "a"), ("", "x"), ("x" * 250 + "y", "y" + "x" * 250)]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = {(r.a, r.b): r.s for r in text.with_ratio(df, "a", "b", "s").collect()}
    assert got == {(a, b): SequenceMatcher(None, a, b).ratio() for a, b in pairs}
    bound = df.select(text.ratcliff_ratio(F.col("a"), F.col("b")).alias("s"), text.ratio_bound(F.col("a"), F.col("b")).alias("m"))
    assert bound.where("s > m + 1e-12").isEmpty()


def test_field_mapping_equals_the_rule(spark):
    fields = {"survey no": "12", "OWNER-NAME": "x", "plot_ref": "7", "zzqq": None, "bldg_count": "3", "Area (sq m)": "12.5", "ward": "5"}
    features = spark.createDataFrame([("DS", 0, "f", fields)], "dataset_id string, ordinal long, feature_id string, properties map<string,string>")

    def number(v):
        try:
            float(v)
            return True
        except (TypeError, ValueError):
            return False

    want = {}
    for f, v in fields.items():
        n, best, top = f.strip().lower().replace(" ", "_").replace("-", "_"), None, 0.0
        for c, names in CANONICAL_SYNONYMS.items():
            s = max(1.0 if n == y else max(SequenceMatcher(None, n, y).ratio(), 0.85 if n in y or y in n else 0) for y in names)
            s += (0.08 if number(v) else -0.05) if c in ("area", "building_count") else (-0.02 if number(v) else 0.03)
            s = max(0.0, min(1.0, s))
            if s > top:
                best, top = c, s
        want[f] = best if top >= 0.25 else f
    got = {r.source_field: r.canonical_field for r in mapping.map_fields(mapping.dataset_field_profile(features)).collect()}
    assert got == want


def test_override_survives(spark):
    generated = spark.createDataFrame([("D", "plot_ref", "parcel_id", 62.0, "fuzzy_synonym"), ("D", "owner", "owner_name", 91.0, "fuzzy_synonym")],
                                      "dataset_id string, source_field string, canonical_field string, confidence double, method string")
    old = spark.createDataFrame([("D", "plot_ref", "survey_number", True), ("D", "owner", "ward", False)],
                                "dataset_id string, source_field string, canonical_field string, manual_override boolean")
    got = {r.source_field: tuple(r)[2:] for r in mapping.manual_override_join(generated, old).collect()}
    assert got == {"plot_ref": ("survey_number", 100.0, "manual_override", True), "owner": ("owner_name", 91.0, "fuzzy_synonym", False)}


def test_mapping_order_and_gaps(spark):
    f = spark.createDataFrame([("D", 0, {"a": "1", "b": "2", "c": "", "area": "raw"})], "dataset_id string, ordinal long, properties map<string,string>")
    rules = spark.createDataFrame([("D", "a", "area"), ("D", "b", "area"), ("D", "c", "ward")], "dataset_id string, source_field string, canonical_field string")
    assert mapping.apply_mapping(f, rules).first().canonical == {"area": "2", "a": "1", "b": "2", "c": ""}


def test_masking_reaches_every_depth(spark):
    doc = '{"Owner":"x","a":{"owner_name":{"first":"y"},"ok":1},"l":[{"LANDHOLDER":["p","q"]},{"property_owner":null}],"owners":"keep"}'
    got = spark.range(1).select(scalar.mask_personal_json(F.lit(doc))).first()[0]
    assert got == ('{"Owner":"REDACTED","a":{"owner_name":"REDACTED","ok":1},"l":[{"LANDHOLDER":"REDACTED"},{"property_owner":"REDACTED"}],"owners":"keep"}')
    deep = [('{"owner":{"id":1,"who":{"name":"SECRET"}},"a":1}', '{"owner":"REDACTED","a":1}'),
            ('{"x":[{"OWNER_NAME":[["S"],[{"b":"]}"}]]}, {"owner" : "q\\"S"}]}', '{"x":[{"OWNER_NAME":"REDACTED"}, {"owner" : "REDACTED"}]}'),
            ('{"owner":{"broken":"S"', '{"owner":"REDACTED"'), ('{"owner":', '{"owner":'), ("plain", "plain"), (None, None)]
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(deep)], "i int, a string")
    got = df.select("i", scalar.mask_personal_json(F.col("a")).alias("m")).orderBy("i").collect()
    assert [r.m for r in got] == [b for _, b in deep]
    bags = df.select("i", scalar.mask_personal_fields(F.create_map(F.lit("Owner"), F.lit("S"), F.lit("j"), "a")).alias("m"))
    assert [r.m for r in bags.orderBy("i").collect()] == [{"Owner": "REDACTED", "j": b} for _, b in deep]
    assert spark.range(1).select(scalar.mask_personal_fields(F.lit(None).cast("map<string,string>"))).first()[0] is None


def test_parcel_changes_write_what_changed(spark):
    cols = "id string, parcel_id string, owner_name string, area double, land_use string, building_count int, geometry_geojson string, parcel_rank long, confidence_score double"
    was = spark.createDataFrame([("a", "P1", 'an "o"', 10.0, "farm", 1, None, 1, 50.0), ("b", "P2", None, 5.0, "farm", 1, None, 2, 50.0),
                                 ("b2", "P2", "zed", 5.0, "farm", 1, None, 3, 50.0)], cols)
    now = spark.createDataFrame([("a", "P1", None, 20.0, "farm", 2, None, 1, 77.0), ("b", "P2", "zed", 5.1, "farm", 1, None, 2, 60.0)], cols)
    got = {(r.change_type, r.feature_ref): (r.before, r.after, r.confidence) for r in changes.parcel_changes(was, now).collect()}
    assert got == {("modified", "a"): ('{"owner_name":"an \\"o\\"","building_count":1}', '{"owner_name":null,"building_count":2}', 77.0),
                   ("geometry_changed", "a"): ('{"area":10.0}', '{"area":20.0}', 50.0)}


def readiness(spark, sources, aoi):
    ds = spark.createDataFrame([(f"D{i}", s) for i, s in enumerate(sources)], "dataset_id string, source_type string")
    bags = {"cadastral": [{"gat_no": "1"}], "revenue": [{"survey_no": "1"}], "gnss": [{"Accuracy_m": "1"}] * 10,
            "orthoimagery": [{"pixel_size": "[0.1,0.1]"}]}
    rows = [(f"{s}{k}", f"D{i}", s, b) for i, s in enumerate(sources) for k, b in enumerate(bags.get(s, [{"x": "1"}]))]
    f = spark.createDataFrame(rows, "feature_id string, dataset_id string, source_type string, properties map<string,string>")
    return tuple(stats.readiness_summary(stats.pilot_readiness(ds, f, aoi)).first())


def test_readiness(spark):
    assert readiness(spark, [], False) == ("NOT_READY", 6)
    full = ["cadastral", "revenue", "municipal", "gnss", "orthoimagery", "utility", "dsm"]
    assert readiness(spark, full, True) == ("READY_FOR_REVIEW", 0)
    assert readiness(spark, full, False) == ("NOT_READY", 1)


def test_preflight_limits(spark):
    g = '{"type":"Point","coordinates":[1,2]}'
    layer_ = spark.createDataFrame([("a.geojson", g), ("a.geojson", g), ("b.csv", None), ("c.tif", g)], "filename string, geometry_geojson string")
    got = {r.filename: r.verdict for r in contracts.preflight_layer(layer_, Settings(max_features=1)).collect()}
    assert got == {"a.geojson": "too_many_features", "b.csv": "ok", "c.tif": "unsupported_type"}


def test_digest_ignores_row_order(spark):
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    a, b = contracts.table_digest(df).first(), contracts.table_digest(df.orderBy(F.desc("id"))).first()
    assert a == b and a != contracts.table_digest(df.withColumn("v", F.col("v") + 1)).first()


def test_columns_check(spark):
    out = contracts.check_columns({"t": spark.sql("select 1 id, 2 token, 3 odd")}, {"t": ["id", "token"]})
    assert {(r.column_name, r.problem) for r in out.collect()} == {("token", "forbidden"), ("odd", "unexpected")}


def test_group_confidence(spark):
    m = spark.createDataFrame([("g", *[float(v)] * 5) for v in (30, 50, 70)], "matched_group_id string, " + ", ".join(f"{s} double" for s in match.SCORES))
    row = match.group_confidence(m, 40).first()
    assert row.matches == 2 and row.overall_confidence == 60


def test_full_run_finds_the_seeded_defects(spark):
    """Bow-tie, exact copy, overlap, crossing building, displaced point, changed owner."""
    from landrecon.sources.readers import as_features

    def ring(x, y, w=0.0006):
        return [[x, y], [x + w, y], [x + w, y + w], [x, y + w], [x, y]]

    def geometry(kind, coordinates):
        import json
        return json.dumps({"type": kind, "coordinates": coordinates})

    x, y = 74.2, 16.7
    rows = [("DS-c", "cadastral", 0, {"parcel_id": "P-0", "owner": "Asha Patil"}, geometry("Polygon", [ring(x, y)])),
            ("DS-c", "cadastral", 1, {"parcel_id": "P-0", "owner": "Asha Patil"}, geometry("Polygon", [ring(x, y)])),
            ("DS-c", "cadastral", 2, {"parcel_id": "P-2", "owner": "Ravi Joshi"}, geometry("Polygon", [ring(x + 0.0003, y)])),
            ("DS-c", "cadastral", 3, {"parcel_id": "P-3", "owner": "Meera Rao"}, geometry("Polygon", [
                [[x + 0.002, y], [x + 0.0026, y + 0.0006], [x + 0.002, y + 0.0006], [x + 0.0026, y], [x + 0.002, y]]])),
            ("DS-r", "revenue", 0, {"survey_no": "P-0", "landholder": "Zubin Q"}, geometry("Polygon", [ring(x, y, 0.0005)])),
            ("DS-r", "revenue", 1, {"survey_no": "P-9", "landholder": "Nobody"}, geometry("Polygon", [ring(x + 0.05, y)])),
            ("DS-m", "municipal", 0, {"property_id": "B-0"}, geometry("Polygon", [ring(x + 0.0004, y, 0.0004)])),
            ("DS-g", "gnss", 0, {"point_id": "1"}, geometry("Point", [x + 0.0003, y + 0.0003])),
            ("DS-g", "gnss", 1, {"point_id": "2"}, geometry("Point", [x + 0.1, y + 0.1])),
            ("DS-u", "utility", 0, {"utility_id": "1"}, geometry("LineString", [[x - 0.001, y + 0.0003], [x + 0.001, y + 0.0003]]))]
    raw = spark.createDataFrame(rows, "dataset_id string, source_type string, ordinal long, properties map<string,string>, geometry_geojson string")
    features = as_features(raw, F.col("dataset_id"), F.col("source_type"))
    out = harmonize(spark, features, datasets(features))
    issues = {r.issue_type: r.n for r in out["validation_results"].groupBy("issue_type").agg(F.sum("pair_count").alias("n")).collect()}
    assert issues == {"self_intersection": 1, "duplicate": 1, "overlap": 2}
    kinds = {r.conflict_type for r in out["conflicts"].select("conflict_type").distinct().collect()}
    assert kinds == {"parcel_overlap", "building_boundary_crossing", "utility_crossing", "area_mismatch", "duplicate_id",
                     "gnss_outside_parcel", "owner_mismatch"}
    parcels = {r.parcel_id + str(r.parcel_rank): r for r in out["unified_parcels"].collect()}
    assert len(parcels) == 5
    best = next(p for p in parcels.values() if p.source_count > 2)
    assert best.owner_name == "Asha Patil" and best.conflict_status == "MAJOR" and best.gnss_verified
    alone = next(p for p in parcels.values() if p.parcel_id == "P-9")
    assert alone.source_count == 1 and alone.confidence_score == 20.0 and alone.validation_status == "FAILED"
    assert out["stages"].where("status = 'completed'").count() == 10
    counts = {r.name: (r.processed, r.warnings) for r in out["stages"].collect()}
    assert counts["Ingestion"] == (datasets(features).count(), 0) and counts["CRS Normalization"] == (len(rows), 0)
    assert counts["Conflict Detection"] == (len(rows), out["conflicts"].count())
    first = [r.change_type for r in out["change_events"].collect()]
    assert first.count("new") == out["unified_parcels"].select("parcel_id").distinct().count()
    linked = out["conflicts"].where("conflict_type <> 'gnss_outside_parcel' and parcel_id is not null")
    assert not linked.isEmpty()
    second = harmonize(spark, out["features"].drop("canonical", *[c for c in out["features"].columns if c.startswith("cmp_")]), datasets(features),
                       previous_validation=out["validation_results"].withColumn("position", F.lit(1)),
                       previous_parcels=changes.snapshot(out["unified_parcels"]))
    assert second["change_events"].isEmpty()
    kept = {r.issue_type for r in second["validation_results"].collect()}
    assert "self_intersection" in kept


def test_output_is_ready_for_one_whole_job_only(spark):
    from landrecon.settings import PIPELINE_STAGES

    one = spark.range(1)
    parcels = spark.createDataFrame([(50.0, ["a"])] * 2, "confidence_score double, lineage array<string>")
    total = spark.createDataFrame([(j, 2 if j else 1) for j in range(12)], "job_id int, total_processed int")

    def ready(reports):
        log = spark.createDataFrame([(j, PIPELINE_STAGES[k], i, ok, 0, 0, 0, "", None) for i, (j, k, ok) in enumerate(reports)],
                                    "job_id int, name string, position int, status string, processed int, warnings int, errors int, "
                                    "detail string, timestamp timestamp")
        return tuple(stats.pipeline_output_ready(one, one, one, parcels, log, total).select(
            "stages_completed", "total_processed", "ready").first())

    whole = [(1, k, "completed") for k in range(9)]
    assert ready([(k, k, "completed") for k in range(9)]) == (False, None, False)
    assert ready(whole) == (True, 2, True)
    assert ready(whole + [(1, 4, "failed")]) == (False, None, False)
    assert ready([(0, k, "completed") for k in range(9)]) == (True, 1, False)


def test_quantiles_are_exact(spark):
    import numpy as np
    from landrecon.sources.readers import exact_quantiles

    rnd = np.random.default_rng(2)
    groups = {"a": rnd.normal(size=501), "b": np.full(7, 3.0), "c": rnd.integers(0, 4, 90).astype(float), "d": np.array([9.0]),
              "e": np.concatenate([np.full(400, 5.0), [1e6]])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "k string, v double")
    for r in exact_quantiles(df, ["k"], "v", (0.02, 0.5, 0.98), 16).collect():
        assert r.q == pytest.approx(list(np.percentile(groups[r.k], (2, 50, 98))))


def test_late_field_gets_a_profile(spark):
    from landrecon.operators import mapping

    rows = [("D", i, f"F{i}", {"a": "1"} if i < 60 else {"late": "2"}) for i in range(61)]
    df = spark.createDataFrame(rows, "dataset_id string, ordinal long, feature_id string, properties map<string,string>")
    found = {(r.source_field, r.sampled, r.sample_value) for r in mapping.dataset_field_profile(df).collect()}
    assert found == {("a", True, "1"), ("late", False, None)}
    values = spark.createDataFrame([("12D",), ("7f",), (" 12.5 ",), ("-3e2",), (None,)], "v string")
    from pyspark.sql import functions as F

    got = [round(r[0], 2) for r in values.select(mapping.datatype_bonus(F.col("v"), F.lit("owner_name"))).collect()]
    assert got == [0.03, 0.03, -0.02, -0.02, 0.03]


def test_larger_limits_are_refused(spark):
    import pytest

    from landrecon.operators import search

    with pytest.raises(ValueError, match="limit"):
        search.top_parcels(spark.createDataFrame([("a", 1.0)], "id string, confidence_score double"), limit=2001)


def test_digest_ignores_the_order_of_maps(spark):
    from landrecon.operators import contracts

    a = spark.sql("SELECT map('a', 1, 'b', 2) AS m, named_struct('y', map('c', 1, 'd', 2), 'x', 1) AS s")
    b = spark.sql("SELECT map('b', 2, 'a', 1) AS m, named_struct('x', 1, 'y', map('d', 2, 'c', 1)) AS s")
    assert contracts.canonical_json_sha256(a).first().row_sha256 == contracts.canonical_json_sha256(b).first().row_sha256
