"""Small column functions on confidences, keys, names and property bags."""

from __future__ import annotations

import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from landrecon.settings import DEFAULTS, OWNER_ROLES, PERSONAL_KEYS, VERSION_KEY_FIELDS, Settings


def normalize_field(name: Column) -> Column:
    return F.translate(F.lower(F.trim(name)), " -", "__")


def confidence_band(percent: Column, cfg: Settings = DEFAULTS) -> Column:
    return (F.when(percent >= cfg.band_high, "High").when(percent >= cfg.band_medium, "Medium")
            .otherwise("Low"))


def needs_review(percent: Column, cfg: Settings = DEFAULTS) -> Column:
    return percent / 100 < cfg.mapping_review


def spatial_proximity(distance: Column, cfg: Settings = DEFAULTS) -> Column:
    score = F.greatest(F.lit(0.0), 1 - F.least(distance / cfg.match_distance_m, F.lit(1.0)))
    return F.coalesce(score, F.lit(0.0))


def area_similarity(a: Column, b: Column) -> Column:
    known = (a > 0) & (b > 0)
    return F.when(known, F.greatest(F.lit(0.0), 1 - F.abs(a - b) / F.greatest(a, b))).otherwise(F.lit(0.5))


def embedding_similarity(a: Column, b: Column) -> Column:
    """Dot product of two unit vectors clamped to 0..1; null for missing or unequal lengths."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                      F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot)))


def unit_vector(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / norm)


def first_present(bag: Column, keys: tuple[str, ...]) -> Column:
    """Value of the first listed key that is neither missing nor blank."""
    return F.coalesce(*[F.nullif(bag[k], F.lit("")) for k in keys])


def feature_key(bag: Column) -> Column:
    """Stable identifier ``field:value`` from the first identifying field with a value."""
    return F.coalesce(*[F.concat(F.lit(k + ":"), F.nullif(bag[k], F.lit(""))) for k in VERSION_KEY_FIELDS])


def stable_event_id(change_type: Column, key: Column) -> Column:
    digest = F.sha2(F.concat(change_type, F.lit(":"), key), 256)
    return F.concat(F.lit("demo-change-"), F.substring(digest, 1, 20))


def natural_id(prefix: str, *cols: Column) -> Column:
    """Deterministic identifier derived from the row's natural key."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in cols])
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(text, 256), 1, 12))


def redact_owner(owner: Column, role: str | None) -> Column:
    return owner if can_view_owners(role) else F.lit("REDACTED")


def can_view_owners(role: str | None) -> bool:
    return role is None or role in OWNER_ROLES


_PERSONAL = "|".join(PERSONAL_KEYS)
_PERSONAL_KEY = re.compile(rf'"(?:{_PERSONAL})"\s*:\s*', re.IGNORECASE)
_NESTED = rf'(?i)"(?:{_PERSONAL})"\s*:\s*[\[{{]'
_WORD = re.compile(r"[^,}\]\s]*")
_JSON = json.JSONDecoder()


def _masked(text: str) -> str:
    """JSON text with every value of a personal key replaced, whatever it nests; all else stays as written."""
    out, at = [], 0
    while (key := _PERSONAL_KEY.search(text, at)) is not None and key.end() < len(text):
        out += text[at : key.end()], '"REDACTED"'
        try:
            at = _JSON.raw_decode(text, key.end())[1]
        except (ValueError, RecursionError):  # not JSON: a word, or nothing that has an end
            at = len(text) if text[key.end() : key.end() + 1] in ("{", "[", '"') else _WORD.match(text, key.end()).end()
    return "".join([*out, text[at:]])


@F.pandas_udf(ArrayType(StringType()))
def _masked_nested(values: pd.Series) -> pd.Series:
    return values.map(lambda texts: texts if texts is None else [None if x is None else _masked(x) for x in texts])


def _masked_scalars(text: Column) -> Column:
    return F.regexp_replace(text, rf'(?i)("(?:{_PERSONAL})"\s*:\s*)("(?:[^"\\]++|\\.)*+"|[^,}}\]\s]+)', '$1"REDACTED"')


def _masked_texts(texts: Column) -> Column:
    """An array of JSON texts with personal values masked. Only arrays with a nested personal value leave the JVM."""
    nested = F.exists(texts, lambda x: F.coalesce(x.rlike(_NESTED), F.lit(False)))
    return F.when(nested, _masked_nested(F.when(nested, texts))).otherwise(F.transform(texts, _masked_scalars))


def mask_personal_fields(bag: Column) -> Column:
    """A property bag with the values of personal keys replaced, those inside JSON values as well."""
    names, values = F.map_keys(bag), _masked_texts(F.map_values(bag))
    return F.map_from_arrays(names, F.zip_with(names, values, lambda k, v: F.when(
        F.lower(k).isin(*PERSONAL_KEYS), F.lit("REDACTED")).otherwise(v)))


def mask_personal_json(text: Column) -> Column:
    """JSON text with the value of every personal key replaced, at any depth and whatever the value nests."""
    return _masked_texts(F.array(text))[0]


def canonical_json(bag: Column) -> Column:
    """Property bag as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(bag))))


def completeness(bag: Column) -> Column:
    """Share of values that are present; blanks and the text NULL count as missing."""
    present = F.size(F.filter(F.map_values(bag), lambda v: v.isNotNull() & ~v.isin("", "NULL")))
    return F.when(bag.isNull(), F.lit(0.0)).otherwise(present / F.greatest(F.lit(1), F.size(bag)))


def attribute_similarity(scores: list[Column]) -> Column:
    """Mean of the comparable field scores, 0.5 when none is comparable."""
    total = reduce(lambda a, b: a + b, [F.coalesce(s, F.lit(0.0)) for s in scores])
    count = reduce(lambda a, b: a + b, [F.when(s.isNotNull(), 1).otherwise(0) for s in scores])
    return F.when(count > 0, total / count).otherwise(F.lit(0.5))


def parcel_provenance(lineage: Column) -> Column:
    values = F.filter(F.transform(F.map_values(lineage), lambda v: v["provenance"]),
                      lambda p: p.isNotNull() & (p != ""))
    label = F.array_distinct(F.transform(
        values, lambda p: F.when(p == "synthetic_demo", "Recorded").otherwise(p)))
    return F.when(F.size(label) > 0, F.array_join(label, ", ")).otherwise("Provenance unavailable")


def summarize_change(change_type: Column, before: Column, after: Column) -> Column:
    """One line of text for a change; ``before`` and ``after`` are property bags."""
    def key(bag: Column) -> Column:
        k = F.coalesce(*[bag[c] for c in ("feature_key", "parcel_id", "linked_parcel", "building_id")])
        return F.coalesce(F.concat(F.lit(" · "), F.nullif(k, F.lit(""))), F.lit(""))

    empty = F.create_map().cast("map<string,string>")
    b, a = F.coalesce(before, empty), F.coalesce(after, empty)
    names = F.array_distinct(F.concat(F.map_keys(b), F.map_keys(a)))
    differs = F.filter(names, lambda k: (k != "feature_key") & (k != "geometry_geojson") & (
        ~b[k].eqNullSafe(a[k]) | (F.map_contains_key(b, k) != F.map_contains_key(a, k))))
    more = F.size(differs) - 4
    listed = F.concat(F.lit("Attributes changed: "), F.array_join(F.slice(differs, 1, 4), ", "),
                      F.when(more > 0, F.concat(F.lit(" +"), more, F.lit(" more"))).otherwise(""))
    return (
        F.when(change_type == "new", F.concat(F.lit("Added feature"), key(a)))
        .when(change_type == "removed", F.concat(F.lit("Feature removed"), key(b)))
        .when(change_type == "geometry_changed", "Feature geometry differs between source versions")
        .when(F.size(differs) > 0, listed)
        .when(~b["geometry_geojson"].eqNullSafe(a["geometry_geojson"]), "Geometry differs between source versions")
        .otherwise("Source feature differs"))
