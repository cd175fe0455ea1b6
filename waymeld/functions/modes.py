"""Travel modes, road classes and access tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import _c

# Source activity labels and the mode each one stands for.
MODE_LABELS = {
    "IN_PASSENGER_VEHICLE": "driving", "IN_VEHICLE": "driving", "DRIVING": "driving",
    "IN_ROAD_VEHICLE": "driving", "MOTORCYCLING": "driving", "IN_BUS": "bus",
    "WALKING": "walking", "ON_FOOT": "walking", "RUNNING": "running",
    "IN_PEDESTRIAN": "walking", "CYCLING": "cycling", "ON_BICYCLE": "cycling", "BIKING": "cycling",
    "IN_TRAIN": "train", "IN_SUBWAY": "train", "IN_TRAM": "train", "IN_CABLECAR": "transit",
    "IN_FERRY": "ferry", "BOATING": "ferry", "FLYING": "flight", "IN_AIRPLANE": "flight",
}

# Highway classes by use.
WALKABLE = ["bridleway", "corridor", "cycleway", "footway", "living_street", "path",
            "pedestrian", "primary", "residential", "road", "secondary", "service",
            "steps", "tertiary", "track", "unclassified"]
LOCAL_ROADS = ["residential", "unclassified", "living_street", "tertiary", "secondary", "primary", "trunk", "pedestrian"]
DRIVING = ["motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential",
           "living_street", "motorway_link", "trunk_link", "primary_link", "secondary_link", "tertiary_link"]


def lookup(pairs: dict[str, str], key: Column) -> Column:
    flat = [F.lit(v) for kv in pairs.items() for v in kv]
    return F.element_at(F.create_map(*flat), key)


def normalise_mode(label) -> Column:
    return F.coalesce(lookup(MODE_LABELS, F.upper(F.trim(_c(label)))), F.lit("unknown"))


def mode_class(mode) -> Column:
    m = _c(mode)
    return (F.when(m.isin("walking", "running"), "on_foot").when(m == "cycling", "cycling")
            .when(m.isin("driving", "bus"), "road").when(m.isin("train", "tram"), "rail").otherwise("other"))


def allowed_modes(tags) -> Column:
    """array<string> of the modes a way's access tags admit.

    The mode's own tag decides first, then vehicle, then access; steps and
    motorways exclude modes unless tagged otherwise.
    """
    t = _c(tags)
    yes, no = ["yes", "designated", "permissive", "official"], ["no", "private", "use_sidepath"]
    highway, access = t["highway"], F.coalesce(t["access"], F.lit("yes"))

    def gate(own: Column, fallback: Column) -> Column:
        return F.when(own.isin(*yes), True).when(own.isin(*no), False).otherwise(fallback)

    open_to_all = ~access.isin(*no)
    foot = gate(t["foot"], open_to_all & ~highway.isin("motorway", "motorway_link"))
    wheels = gate(t["vehicle"], open_to_all)
    bike = gate(t["bicycle"], wheels & ~highway.isin("motorway", "motorway_link", "steps", "footway"))
    motor = gate(t["motor_vehicle"], wheels & highway.isin(*DRIVING, "service"))
    return F.filter(F.array(F.when(foot, "on_foot"), F.when(bike, "cycling"), F.when(motor, "driving")),
                    lambda m: m.isNotNull())


def one_way(tags) -> Column:
    """1 along the way, -1 against it, 0 both, null when the tag is not understood."""
    t = _c(tags)
    v = F.coalesce(t["oneway"], F.lit(""))
    return (F.when(v.isin("yes", "1", "true"), 1).when(v.isin("-1", "reverse"), -1)
            .when(v.isin("reversible", "alternating"), F.lit(None).cast("int"))
            .when((v == "") & (t["highway"].isin("motorway", "motorway_link")
                               | F.coalesce(t["junction"].isin("roundabout", "circular"), F.lit(False))), 1)
            .when(v.isin("", "no", "0", "false"), 0))
