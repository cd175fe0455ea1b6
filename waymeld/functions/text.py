"""Road references, names, locations and unit conversions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import _c

KM_PER_MILE = 1.609344

# Region box of the Northern Ireland networks and the two support boxes.
NI_BOX = (-8.5, 53.8, -5.0, 55.5)
GB_BOX = (-8.8, 49.8, 2.2, 61.1)

# Letters folded when venue names are compared.
FOLD_FROM = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
FOLD_TO = "aaaaaaceeeeiiiinoooooouuuuyy"


def in_box(lng, lat, box: tuple[float, float, float, float]) -> Column:
    west, south, east, north = box
    return F.coalesce(_c(lng).between(west, east) & _c(lat).between(south, north), F.lit(False))


def uk_supported(lng, lat) -> Column:
    return in_box(lng, lat, GB_BOX) | in_box(lng, lat, NI_BOX)


def region_of(lng, lat, box: tuple[float, float, float, float] = NI_BOX) -> Column:
    """Road numbers repeat between the islands, so the region is part of identity."""
    return F.when(in_box(lng, lat, box), "NI").otherwise("GB")


def ref_parts(ref) -> Column:
    parts = F.split(F.upper(F.coalesce(_c(ref), F.lit(""))), "[;,/]")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"\s+", "")), lambda p: p != "")


def motorway_refs(ref) -> Column:
    named = F.transform(ref_parts(ref), lambda p: F.when(p.isin("M6T", "M6TOLL"), "M6 Toll")
                        .when(p.rlike(r"^M\d+[A-Z]?$") | p.rlike(r"^A\d+\(M\)$"), p))
    return F.filter(named, lambda p: p.isNotNull())


def a_road_refs(ref) -> Column:
    return F.filter(ref_parts(ref), lambda p: p.rlike(r"^A\d+[A-Z]?$"))


def squeeze(name) -> Column:
    return F.lower(F.trim(F.regexp_replace(_c(name), r"\s+", " ")))


def fold_name(name, brand_words: list[str] | None = None) -> Column:
    """Accent- and punctuation-free name without brand words and a leading article."""
    plain = F.translate(F.lower(_c(name)), FOLD_FROM, FOLD_TO)
    plain = F.regexp_replace(plain, r"&", " and ")
    plain = F.regexp_replace(plain, r"['’]", "")
    plain = F.regexp_replace(plain, r"[^a-z0-9]+", " ")
    for word in brand_words or []:
        plain = F.regexp_replace(plain, rf"\b{word}\b", " ")
    plain = F.trim(F.regexp_replace(plain, r"\s+", " "))
    return F.regexp_replace(plain, r"^the ", "")


def service_key(name) -> Column:
    """Service-area name without direction and service words."""
    key = F.regexp_replace(F.lower(_c(name)), r"\b(north|south|east|west)bound\b", " ")
    key = F.regexp_replace(key, r"\b(motorway|services?|service area|north|south|east|west)\b", " ")
    return F.trim(F.regexp_replace(key, r"[^a-z0-9]+", " "))


def natural_ref(ref) -> list[Column]:
    """Sort keys: letters, then the number as a number, then the rest."""
    r = _c(ref)
    return [F.regexp_extract(r, r"^([A-Za-z]*)", 1),
            F.coalesce(F.nullif(F.regexp_extract(r, r"(\d+)", 1), F.lit("")).cast("int"), F.lit(0)), r]


def discovery_key(ref, name, highway) -> Column:
    """struct(id, label, category) of a discovered road, or null when it is none."""
    ref = F.upper(F.trim(F.coalesce(_c(ref), F.lit(""))))
    name = F.trim(F.coalesce(_c(name), F.lit("")))
    kind = F.lower(F.coalesce(_c(highway), F.lit("")))
    number = r"^\d+(?:[.,]\d+)?$"
    numeric_ref, numeric_name = ref.rlike(number), name.rlike(number)
    tight = F.regexp_replace(ref, r"\s+", "")
    shown = (F.when(numeric_ref, "").when(tight.isin("M6T", "M6TOLL"), "M6 Toll").otherwise(tight))
    refused = (((ref == "") & (name == "")) | kind.rlike(r"_link$|^(service|footway|path|steps|cycleway)$")
               | ((ref == "") & numeric_name) | (numeric_ref & ((name == "") | numeric_name)))
    category = (F.when(shown.rlike(r"^(M[0-9]+|A[0-9]+\(M\)|M6 Toll)$"), "Motorways")
                .when(shown.rlike(r"^A[0-9]+$"), "A roads")
                .when(shown.rlike(r"^B[0-9]+$"), "B roads").otherwise("Local roads"))
    return F.when(~refused, F.struct(
        F.when(shown != "", F.concat(F.lit("ref:"), shown)).otherwise(F.concat(F.lit("name:"), F.lower(name))).alias("id"),
        F.when(shown != "", shown).otherwise(name).alias("label"), category.alias("category")))


def parse_location(text) -> Column:
    """struct(lat, lng) from any of the export spellings of a position.

    Handles "51.5°, -0.1°", "geo:51.5,-0.1", {latitude,longitude}, {lat,lng|lon},
    E7 integers and the same nested in a holder object.
    """
    t = _c(text)
    json_like = t.rlike(r"^\s*\{")
    field = lambda names: F.coalesce(*[F.nullif(F.regexp_extract(t, rf'"{n}"\s*:\s*"?(-?\d+(?:\.\d+)?)', 1), F.lit("")) for n in names])
    e7_lat, e7_lng = field(["latitudeE7", "latE7"]), field(["longitudeE7", "lngE7"])
    d_lat, d_lng = field(["latitude", "lat"]), field(["longitude", "lng", "lon"])
    numbers = F.regexp_extract_all(t, F.lit(r"(-?\d+(?:\.\d+)?)"), 1)
    lat = F.when(json_like, F.coalesce(e7_lat.try_cast("double") / 1e7, d_lat.try_cast("double"),
                                       F.try_element_at(numbers, F.lit(1)).try_cast("double"))
                 ).otherwise(F.try_element_at(numbers, F.lit(1)).try_cast("double"))
    lng = F.when(json_like, F.coalesce(e7_lng.try_cast("double") / 1e7, d_lng.try_cast("double"),
                                       F.try_element_at(numbers, F.lit(2)).try_cast("double"))
                 ).otherwise(F.try_element_at(numbers, F.lit(2)).try_cast("double"))
    ok = lat.between(-90, 90) & lng.between(-180, 180)
    return F.when(F.coalesce(ok, F.lit(False)), F.struct(lat.alias("lat"), lng.alias("lng")))


def percent(covered, total) -> Column:
    """Covered share in percent, held within [0, 100]; 0 for an empty reference."""
    c, t = _c(covered), _c(total)
    return F.when(t > 0, F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.try_divide(c * 100.0, t)))).otherwise(0.0)


def snap_threshold(value, target, rel: float = 1e-12) -> Column:
    """Lift a value that misses its target only by rounding."""
    v, t = _c(value), _c(target)
    return F.when(F.abs(v - t) <= F.abs(t) * rel, t).otherwise(v)


def text_digest(*parts) -> Column:
    return F.sha2(F.concat_ws("\u001f", *[_c(p).cast("string") for p in parts]), 256)


def digest_number(text) -> Column:
    """First 32 bits of a SHA-256, as a number that can be summed over rows."""
    return F.conv(F.substring(F.sha2(_c(text), 256), 1, 8), 16, 10).cast("long")


def index_complement(matched, count) -> Column:
    """Indices of range(count) that are not in `matched`."""
    n = _c(count).cast("int")
    return F.when(n > 0, F.array_except(F.sequence(F.lit(0), n - 1), _c(matched))).otherwise(F.array().cast("array<int>"))


def repeat_cell(lat, lng) -> Column:
    k = lambda v: (F.floor(_c(v) * 500 + 0.5)).cast("long").cast("string")
    return F.concat_ws(",", k(lat), k(lng))


def road_fingerprint(mode, first: Column, last: Column, km) -> Column:
    """Endpoints as an unordered pair of .002 degree cells, plus half-kilometre bucket."""
    return F.concat_ws("|", _c(mode), F.least(first, last), F.greatest(first, last),
                       F.floor(_c(km) * 2 + 0.5).cast("long").cast("string"))
