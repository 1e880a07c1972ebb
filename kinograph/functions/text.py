"""Closed-vocabulary slots from descriptions, their scoring, rendering and tolerant JSON, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# vocabularies
UNKNOWN = "unknown"
TYPES = ["enter_vehicle", "exit_vehicle", "open_close_door", "load_unload", "attend_vehicle"]
NEGATIVE = "pass_by"
DARK = ["black", "dark", "brown", "blue", "green", "purple", "navy"]
LIGHT = ["white", "light", "beige", "yellow", "pink", "silver", "cream"]
EITHER = ["grey", "red", "orange"]
COLOURS = DARK + LIGHT + EITHER + ["gray"]
LUMINANCE = ["dark", "light"]
UPPER = ["shirt", "top", "t-shirt", "jacket", "coat", "hoodie", "sweater", "blouse", "dress"]
LOWER = ["pants", "shorts", "trousers", "jeans", "skirt", "leggings"]
BODIES = {"sedan": "sedan", "hatchback": "hatchback", "suv": "suv", "van": "van", "minivan": "van", "pickup": "pickup", "truck": "truck", "bus": "bus"}
STATES = [("starting to drive", "moving"), ("driving", "moving"), ("moving", "moving"), ("parked", "static"), ("stopped", "static")]
PERSON_SLOTS = {
    "sex": ["male", "female", "unknown"],
    "age": ["adult", "child", "unknown"],
    "upper_color": ["black", "white", "grey", "silver", "red", "blue", "green", "yellow", "orange", "brown", "beige", "pink", "purple", "dark", "light", "unknown"],
    "lower_color": ["black", "white", "grey", "silver", "red", "blue", "green", "yellow", "orange", "brown", "beige", "pink", "purple", "dark", "light", "unknown"],
    "carrying": ["yes", "no", "unknown"],
}
VEHICLE_SLOTS = {
    "color": PERSON_SLOTS["upper_color"],
    "body_type": ["sedan", "hatchback", "suv", "van", "pickup", "truck", "bus", "motorcycle", "other", "unknown"],
    "state": ["parked", "stopped", "moving", "unknown"],
}
CLASS_NAMES = {0: "person", 1: "bicycle", 2: "car", 3: "motorcycle", 5: "bus", 7: "truck"}
SYNONYMS = [(0, "person"), (1, "bicycle"), (1, "bike"), (2, "car"), (3, "motorcycle"), (3, "motorbike"), (5, "bus"), (7, "truck"), (7, "lorry")]


def words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def colours_in(text: Column) -> Column:
    """The sorted distinct colour words among the runs of letters."""
    return F.array_sort(F.array_distinct(F.array_intersect(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)), words(COLOURS))))


def _or_unknown(colours: Column) -> Column:
    return F.when(F.size(colours) > 0, colours)


def person_slots(desc: Column) -> Column:
    """struct<sex, age, upper_color array, lower_color array, carrying boolean>; NULL in a slot: unknown.

    The first comma part says who; the next two may name clothes, and the first of them that doesn't ends the clothes.
    More parts than clothes mean that something is carried, where any clothes are named.
    """
    parts = F.filter(F.transform(F.split(F.coalesce(desc, F.lit("")), ","), lambda t: F.lower(F.trim(t))), lambda t: t != "")
    tokens = lambda k: F.split(F.coalesce(F.get(parts, F.lit(k)), F.lit("")), r"\s+")
    has = lambda t, names: F.arrays_overlap(t, words(names))
    who = tokens(0)
    age = F.when(has(who, ["adult"]), "adult").when(has(who, ["young", "child", "boy", "girl", "baby"]), "child")
    sex = F.when(has(who, ["man", "male", "boy"]), "male").when(has(who, ["woman", "female", "girl"]), "female")
    t1, t2 = F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    w1, w2 = tokens(1), tokens(2)
    both1, both2 = has(w1, ["clothes", "clothing"]), has(w2, ["clothes", "clothing"])
    c1, c2 = _or_unknown(colours_in(t1)), _or_unknown(colours_in(t2))
    kind1 = F.when(both1, "both").when(has(w1, UPPER), "upper").when(has(w1, LOWER), "lower")
    # a slot that is taken with a colour can't be taken again; one whose part named no colour is still open
    upper_open, lower_open = ~((kind1 == "upper") & c1.isNotNull()), ~((kind1 == "lower") & c1.isNotNull())
    kind2 = F.when(kind1.isNull() | (kind1 == "both"), None).when(both2, "both").when(has(w2, UPPER) & upper_open, "upper").when(has(w2, LOWER) & lower_open, "lower")
    upper = F.when(kind2 == "both", c2).when(kind2 == "upper", c2).when((kind1 == "both") | (kind1 == "upper"), c1)
    lower = F.when(kind2 == "both", c2).when(kind2 == "lower", c2).when((kind1 == "both") | (kind1 == "lower"), c1)
    # a part that names clothes as a whole counts once, in the place of a garment before it
    count = F.when(kind1.isNull(), 0).when((kind1 == "both") | kind2.isNull() | (kind2 == "both"), 1).otherwise(2)
    carrying = F.when(count > 0, F.size(parts) - 1 > count)
    return F.struct(sex.alias("sex"), age.alias("age"), upper.alias("upper_color"), lower.alias("lower_color"), carrying.alias("carrying"))


def vehicle_slots(desc: Column) -> Column:
    """struct<color array, body_type, state>: the first body word in the text and the first phrase in the list's order."""
    low = F.lower(F.coalesce(desc, F.lit("")))
    found = F.filter(F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0)), lambda w: w.isin(list(BODIES)))
    body = F.element_at(_literal_map(BODIES), F.get(found, F.lit(0)))
    state = F.coalesce(*[F.when(F.contains(low, F.lit(p)), s) for p, s in STATES])
    return F.struct(_or_unknown(colours_in(low)).alias("color"), body.alias("body_type"), state.alias("state"))


def _hue(c: Column) -> Column:
    return F.when(c.isin("silver", "gray"), "grey").otherwise(c)


def _lightness(c: Column) -> Column:
    return F.when(c.isin(DARK), F.array(F.lit("dark"))).when(c.isin(LIGHT), F.array(F.lit("light"))).when(c.isin(EITHER), F.array(F.lit("dark"), F.lit("light"))).otherwise(F.array().cast("array<string>"))


def compare_colour(truth: Column, predicted: Column) -> tuple[Column, Column]:
    """(hue, lightness) outcomes correct / wrong / abstain of one predicted colour against a set; NULL: not scorable."""
    predicted = F.coalesce(predicted, F.lit(UNKNOWN))
    scorable = truth.isNotNull() & (F.size(truth) > 0)
    hues = F.transform(F.filter(truth, lambda c: ~c.isin(LUMINANCE)), _hue)
    named = F.size(hues) > 0
    hue = F.when(~scorable | ~named, None).when(predicted == UNKNOWN, "abstain").when(predicted.isin(LUMINANCE), "abstain").when(F.array_contains(hues, _hue(predicted)), "correct").otherwise("wrong")
    lights = F.flatten(F.transform(truth, _lightness))
    light = F.when(~scorable, None).when(predicted == UNKNOWN, "abstain").when(F.arrays_overlap(_lightness(predicted), lights), "correct").otherwise("wrong")
    return hue, light


def compare_exact(truth: Column, predicted: Column) -> Column:
    predicted = F.coalesce(predicted, F.lit(UNKNOWN))
    return F.when(truth.isNull() | (truth == UNKNOWN), None).when(predicted == UNKNOWN, "abstain").when(truth == predicted, "correct").otherwise("wrong")


def score_slots(person: Column, vehicle: Column, person_attrs: Column, vehicle_attrs: Column) -> Column:
    """map<slot, outcome> of one matched pair without the slots that can't be scored; attrs are structs of strings."""
    entries = {"person.sex": compare_exact(person["sex"], person_attrs["sex"]), "person.age": compare_exact(person["age"], person_attrs["age"])}
    for slot in ("upper_color", "lower_color"):
        entries[f"person.{slot}.hue"], entries[f"person.{slot}.lightness"] = compare_colour(person[slot], person_attrs[slot])
    carried = F.coalesce(person_attrs["carrying"], F.lit(UNKNOWN))
    entries["person.carrying"] = F.when(person["carrying"].isNull(), None).when(carried == UNKNOWN, "abstain").when((carried == "yes") == person["carrying"], "correct").otherwise("wrong")
    entries["vehicle.color.hue"], entries["vehicle.color.lightness"] = compare_colour(vehicle["color"], vehicle_attrs["color"])
    entries["vehicle.body_type"] = compare_exact(vehicle["body_type"], vehicle_attrs["body_type"])
    state = F.when(vehicle_attrs["state"].isin("parked", "stopped"), "static").otherwise(vehicle_attrs["state"])
    entries["vehicle.state"] = compare_exact(vehicle["state"], state)
    return F.map_filter(F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())


def closed(value: Column, vocabulary: list[str]) -> Column:
    """Trimmed, lower-cased, gray as grey; unknown where the vocabulary lacks it."""
    v = F.replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), F.lit("gray"), F.lit("grey"))
    return F.when(v.isin(vocabulary), v).otherwise(UNKNOWN)


def free(value: Column) -> Column:
    v = F.trim(F.coalesce(value, F.lit("")))
    return F.when(v == "", UNKNOWN).otherwise(v)


def _known(value: Column) -> Column:
    return F.nullif(value, F.lit(UNKNOWN))


def render_person(a: Column) -> Column:
    """Text of a struct of slots; unknown parts are left out."""
    blank = lambda c: F.nullif(c, F.lit(""))
    who = F.coalesce(blank(F.concat_ws(" ", _known(a["age"]), _known(a["sex"]))), F.lit("person"))
    clothes = [blank(F.concat_ws(" ", _known(a[c]), _known(a[g]))) for c, g in (("upper_color", "upper_garment"), ("lower_color", "lower_garment"))]
    return F.concat_ws(", ", who, *clothes, F.when(a["carrying"] == "yes", "carrying an object"))


def render_vehicle(a: Column) -> Column:
    return F.coalesce(F.nullif(F.concat_ws(", ", _known(a["color"]), _known(a["body_type"]), _known(a["state"])), F.lit("")), F.lit("vehicle"))


def prompt(phrases: Column) -> Column:
    """Phrases trimmed, lower-cased, ended by one dot each, joined by spaces; empty ones are left out."""
    clean = F.transform(phrases, lambda p: F.regexp_replace(F.lower(F.trim(p)), r"\.+$", ""))
    return F.array_join(F.transform(F.filter(F.transform(clean, lambda p: F.trim(p)), lambda p: p != ""), lambda p: F.concat(p, F.lit("."))), " ")


def json_body(text: Column) -> Column:
    """The text from the first { to the last }, within a leading code fence if there is one; NULL without."""
    s = F.trim(text)
    fenced = F.regexp_replace(F.get(F.split(s, "```"), F.lit(1)), "^json", "")
    return F.nullif(F.regexp_extract(F.when(F.startswith(s, F.lit("```")), fenced).otherwise(s), r"(?s)\{.*\}", 0), F.lit(""))


def parse_verdict(text: Column) -> Column:
    """struct<type, confidence, person_desc, vehicle_desc, note>, or NULL where there is no JSON with a known type."""
    got = F.from_json(json_body(text), "type string, confidence string, person_desc string, vehicle_desc string, note string")
    # coalesce stands innermost: least and greatest skip NULL
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(got["confidence"].try_cast("double"), F.lit(0.0))))
    fields = [F.coalesce(got[f], F.lit("")).alias(f) for f in ("person_desc", "vehicle_desc", "note")]
    return F.when(got["type"].isin(TYPES + [NEGATIVE]), F.struct(got["type"].alias("type"), confidence.alias("confidence"), *fields))


def parse_description(text: Column) -> Column:
    """struct<person, vehicle> of slots; single bad slots become unknown; NULL where neither object is there."""
    person = ", ".join(f"{k}: string" for k in [*PERSON_SLOTS, "upper_garment", "lower_garment"])
    vehicle = ", ".join(f"{k}: string" for k in VEHICLE_SLOTS)
    got = F.from_json(json_body(text), f"person struct<{person}>, vehicle struct<{vehicle}>")
    p = F.struct(*[closed(got["person"][k], v).alias(k) for k, v in PERSON_SLOTS.items()], *[free(got["person"][k]).alias(k) for k in ("upper_garment", "lower_garment")])
    v = F.struct(*[closed(got["vehicle"][k], vocab).alias(k) for k, vocab in VEHICLE_SLOTS.items()])
    return F.when(got["person"].isNotNull() | got["vehicle"].isNotNull(), F.struct(p.alias("person"), v.alias("vehicle")))


def content_key(*parts: Column) -> Column:
    """A stable key of its parts. Each is written after its length, a NULL as a mark of its own, so that different parts never
    give one text."""
    texts = [p.cast("string") for p in parts]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)
