"""Rules of nested sample records, mapping specs, checklists and graph models: one finding for each rule that a part breaks.

Documents are JSON texts, parsed once each into a variant, which is read once more as a struct of what the rules ask for:
members that are missing or of another kind are null there, and only those whose kind matters stay variants. Every rule is
a column expression on the struct that gives the parts that break it, so that a table of documents is one narrow pass.
Sections of another kind than their rules expect count as empty, never as an error of the job.

Sample records are read as texts first, which nearly always tell that a section is sound. Where they don't, the section is
read again with the kinds of its values, and only then do its rules name parts: that is many times dearer, as functions of
lists are interpreted and each scalar of a variant takes a cast. Texts only ever pass over what breaks no rule; the rules
alone decide on the rest.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.functions.scores import ITEMS

# The fields of a sample record and the controlled values of its parts.
SECTIONS = ("record_type", "dataset_id", "dataset_identity", "sample_id", "source_clip_id", "source", "harmonisation", "access", "study", "acoustic_environment", "people", "context", "sound_sources", "audio", "visual", "alignment", "perception", "features", "knowledge_graph", "harmonisation_potential", "missingness", "provenance", "validation")
LEVELS = ("structural_harmonisation", "semantic_harmonisation", "feature_harmonisation", "statistical_harmonisation", "benchmark_split_harmonisation")
VIEWS = ("audio_view", "visual_view", "context_view", "perception_view", "feature_view")
LEVEL_STATUSES = ("aligned", "partially_aligned", "documented_only", "not_performed", "not_applicable", "unknown")
VIEW_STATUSES = ("available", "partial", "not_reported", "not_accessible", "not_applicable", "unknown")
ALIGNMENT_STATUSES = ("schema_aligned", "partially_schema_aligned", "not_aligned", "unknown")
MISSING_STATUSES = ("available", "not_collected", "not_reported", "not_accessible", "not_applicable", "unknown")
ACCESS_STATUSES = ("open", "restricted", "request_required", "closed", "unknown")
VALIDATION_STATUSES = ("unchecked", "valid", "valid_with_warnings", "invalid")
ENVIRONMENTS = ("real", "recorded", "virtual", "unknown")
SETTINGS = ("field", "laboratory", "mixed", "unknown")
CHANNELS = ("mono", "stereo", "binaural", "ambisonic", "unknown")
VISUALS = ("none", "image", "video", "vr", "eye_tracking", "derived_visual_feature", "unknown")
SOURCES = ("paper", "dataset_documentation", "metadata_file", "manual_inspection", "code_extraction", "author_communication", "unknown")
ITEM_TYPES = ("raw_response", "aggregated_sample_annotation")
FEATURE_GROUPS = ("acoustic_indicators", "psychoacoustic_indicators", "derived_features")
NODE_TYPES = ("Dataset", "Sample", "AudioAsset", "VisualAsset", "PAQAnnotation", "ISO12913Item", "DerivedCoordinate", "FeatureRecord", "Context", "AcousticEnvironment", "ParticipantGroup")
RELATIONS = ("has_sample", "has_audio", "has_visual", "has_context", "has_acoustic_environment", "has_participant_group", "has_annotation", "uses_framework_item", "has_derived_coordinate", "has_feature", "derived_from")
CONFIDENCES = ("high", "medium", "low", "unknown")
EVIDENCE = ("source_schema", "paper", "metadata_file", "manual_inspection", "code_extraction", "author_communication", "unknown")
REVIEWS = ("proposed", "reviewed", "accepted")
MAPPING_FIELDS = ("original_field", "target_field", "semantic_basis", "transformation", "required", "missingness_rule", "provenance_note", "mapping_confidence", "evidence_type", "review_status", "ambiguity_note", "source_column_examples")
GRAPH_FIELDS = ("node_types", "relation_types", "alignment_views", "scope_note")
FRAMEWORK, SCOPE, ITEM_PATH = "ISO_12913", "schema_level", "perception.iso_12913.paq."
COORDINATES = ("pleasantness", "eventfulness")

#: Texts of values that count as not given, unless they are texts themselves.
EMPTY = ("0", "0.0", "false", "[]", "{}")
VARIANTS, MAP = "array<variant>", "map<string,variant>"
#: Kinds that tell objects, keys and lists apart from all else: values are not copied, and what is no object is null at no
#: cost, where a cast of scalars would make an error for each.
OBJECT = "struct<_:variant>"
KEYS, LIST = f"map<string,{OBJECT}>", f"array<{OBJECT}>"

_ASSESSED = "status:string,note:variant"
#: What the rules of sample records look into, by section; `alignment` and `features` as maps, as their keys count.
SAMPLE = {
    "record_type": "string", "dataset_id": "variant", "sample_id": "variant",
    "harmonisation": f"struct<scope:string,levels:map<string,struct<{_ASSESSED}>>,checklist:array<struct<item:string,{_ASSESSED}>>>",
    "access": "struct<status:string>", "study": "struct<environment_type:string,setting:string>", "audio": "struct<channel_type:string>", "visual": "struct<type:string,asset:variant>", "alignment": "map<string,string>",
    "perception": "struct<framework:string,iso_12913:struct<paq:map<string,struct<value:variant,original_field:variant,value_type:string>>,derived_coordinates:map<string,struct<method:variant,source:variant,value_type:string>>>>",
    "features": "map<string,array<struct<name:string,method:variant,provenance:variant>>>",
    "knowledge_graph": "struct<nodes:array<struct<id:variant,type:variant,label:variant>>,edges:array<struct<source:string,target:string,relation:variant>>>",
    "harmonisation_potential": "struct<score:variant,components:array<struct<name:variant,score:variant,status:string,reason:variant>>>",
    "missingness": "array<struct<field:string,status:string>>", "provenance": "array<struct<source_type:string,note:variant>>", "validation": "struct<status:string>"}
MAPPING = f"struct<dataset_id:string,semantic_framework:string,harmonisation_scope:string,mappings:array<struct<target_field:string,mapping_confidence:string,evidence_type:string,review_status:string,source_column_examples:{LIST}>>>"
ERROR, WARNING = "error", "warning"
FINDINGS = "array<struct<severity:string,rule:string,part:string>>"

Rule = tuple[str, str, Column]


def no_parts() -> Column:
    return F.array().cast("array<string>")


def part(v: Column, name: str) -> Column:
    """A member of an object, null if there is none."""
    return F.try_variant_get(v, f"$.{name}", "variant")


def plain(v: Column) -> Column:
    """A scalar as text, without quotes; null for null. Objects and lists give their JSON text."""
    return F.try_variant_get(v, "$", "string")


def given(v: Column) -> Column:
    """Whether a value is there and neither null, zero, false nor empty."""
    return surely(plain(v)) | (among(plain(v), EMPTY) & kind_is(v, "STRING"))


def surely(text: Column) -> Column:
    """Whether the text of a value tells by itself that the value is given()."""
    return F.coalesce(~text.isin("", *EMPTY), F.lit(False))


def one_of(v: Column, options: tuple[str, ...]) -> Column:
    return among(plain(v), options)


def kind_is(v: Column, kind: str) -> Column:
    """Whether a value's type, as Spark names it, begins so; meant for scalars."""
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", OBJECT).isNotNull()


def is_list(v: Column) -> Column:
    return F.try_variant_get(v, "$", LIST).isNotNull()


def keys_of(v: Column, path: str = "$") -> Column:
    """The keys of an object; none for anything else."""
    return F.coalesce(F.map_keys(F.try_variant_get(v, path, KEYS)), no_parts())


def members(v: Column) -> Column:
    """An object as a map; empty for anything else."""
    return F.coalesce(F.try_variant_get(v, "$", MAP), F.create_map().cast(MAP))


def entries(v: Column) -> Column:
    """A list's values; none for anything else."""
    return F.coalesce(F.try_variant_get(v, "$", VARIANTS), F.array().cast(VARIANTS))


def share(v: Column) -> Column:
    """Whether a value is a number, or a truth value, from 0 to 1."""
    number = F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|BOOLEAN)")
    return F.coalesce(number & F.try_variant_get(v, "$", "double").between(0, 1), F.lit(False))


def among(text: Column, options: tuple[str, ...]) -> Column:
    return F.coalesce(text.isin(*options), F.lit(False))


def broken(bad: Column, named: str | Column) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.array(F.lit(named) if isinstance(named, str) else named)).otherwise(no_parts())


def named(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values))


def no_entry(listed: Column) -> Column:
    return F.coalesce(F.size(listed) < 1, F.lit(True))


def lacking(wanted: tuple[str, ...], keys: Column) -> Column:
    """The wanted names that are no keys, as one part, in order."""
    gone = F.array_sort(F.array_except(named(wanted), keys))
    return broken(F.size(gone) > 0, F.array_join(gone, ","))


def beyond(keys: Column, known: tuple[str, ...]) -> Column:
    more = F.array_sort(F.array_except(keys, named(known)))
    return broken(F.size(more) > 0, F.array_join(more, ","))


def each(items: Column, bad: Callable[[Column], Column], name: Callable[[Column], Column]) -> Column:
    """The names of the items that are bad; of several alike, one each. No list has none."""
    found = F.transform(F.filter(items, lambda x: F.coalesce(bad(x), F.lit(False))), lambda x: F.coalesce(name(x), F.lit("?")))
    return F.coalesce(found, no_parts())


def of_objects(rule: str, items: Column, name: Callable[[Column], Column], value: Callable[[Column], Column], checks: dict[str, Callable[[Column], Column]]) -> list[Rule]:
    """Items must be objects (rule_object), others being null, and objects must pass each check (rule_<its name>)."""
    out = [(f"{rule}_object", ERROR, each(items, lambda x: value(x).isNull(), name))]
    return out + [(f"{rule}_{k}", ERROR, each(items, lambda x, c=check: value(x).isNotNull() & ~c(value(x)), name)) for k, check in checks.items()]


def by_key(rule: str, pairs: Column, checks: dict[str, Callable[[Column], Column]]) -> list[Rule]:
    return of_objects(rule, pairs, lambda e: e["key"], lambda e: e["value"], checks)


def by_name(rule: str, listed: Column, name: Callable[[Column], Column], checks: dict[str, Callable[[Column], Column]]) -> list[Rule]:
    return of_objects(rule, listed, name, lambda x: x, checks)


def shape(*sections: str) -> str:
    return f"struct<{','.join(f'{s}:{SAMPLE[s]}' for s in sections)}>"


#: The ids of a record, in the order in which it goes by them.
IDS = ("sample_id", "dataset_id")
#: A sample record in texts, but for scores, of which texts don't tell whether they are numbers, and what only has to be there.
TEXTS = re.sub(r"(?<!value:)(?<!original_field:)(?<!score:)variant", "string", shape(*SAMPLE))


def opened(docs: DataFrame) -> DataFrame:
    """docs(row_key, _doc) with each record's texts (_t) and the keys at its top (_keys), null where it is no object."""
    doc = F.col("_doc")
    return docs.withColumns({"_t": F.try_variant_get(doc, "$", TEXTS), "_keys": F.map_keys(F.try_variant_get(doc, "$", KEYS))})


def given_at(name: str) -> Column:
    """given() for an id of an opened() record."""
    return surely(F.col("_t")[name]) | given(part(F.col("_doc"), name))


def all_of(*conditions: Column) -> Column:
    return reduce(Column.__and__, conditions)


def all_pass(items: Column, good: Callable[[Column], Column]) -> Column:
    """Whether all items are surely good; no list has none that is not."""
    return F.coalesce(F.forall(items, lambda x: F.coalesce(good(x), F.lit(False))), F.lit(True))


def each_key(pairs: Column, wanted: tuple[str, ...], good: Callable[[Column], Column]) -> Column:
    """Whether an object's keys are the wanted ones, in the order that variants keep, and all values surely good."""
    return (F.map_keys(pairs) == named(tuple(sorted(wanted)))) & all_of(*[good(F.try_element_at(pairs, F.lit(k))) for k in wanted])


def keys_in(pairs: Column) -> Column:
    return F.coalesce(F.map_keys(pairs), no_parts())


def told_in(r: Column) -> Column:
    """The fields that missingness tells of."""
    return F.coalesce(F.filter(F.transform(r["missingness"], lambda m: m["field"]), F.isnotnull), no_parts())


_STATUS = {"status": lambda x: among(x["status"], LEVEL_STATUSES), "note": lambda x: given(x["note"])}


def text_rules(framed: tuple[str, ...]) -> list[Rule]:
    """Rules that the texts of opened() records answer; records of the datasets in `framed` need the framework."""
    t, keys = F.col("_t"), F.col("_keys")
    views = t["alignment"]
    view = lambda v: F.try_element_at(views, F.lit(v))
    whole = F.coalesce(keys == named(tuple(sorted(SECTIONS))), F.lit(False))
    issues = F.try_variant_get("_doc", "$.alignment.unresolved_issues", LIST)
    controlled = {"R04": ("harmonisation", "scope", (SCOPE,)), "R08": ("access", "status", ACCESS_STATUSES), "R09": ("study", "environment_type", ENVIRONMENTS), "R10": ("study", "setting", SETTINGS),
                  "R11": ("audio", "channel_type", CHANNELS), "R12": ("visual", "type", VISUALS), "R28": ("validation", "status", VALIDATION_STATUSES)}
    return [
        ("R01", ERROR, F.when(whole, no_parts()).otherwise(lacking(SECTIONS, keys))),
        ("R02", ERROR, broken(~given_at("dataset_id"), "dataset_id")),
        ("R03", ERROR, broken(~given_at("sample_id"), "sample_id")),
        *[(rule, ERROR, broken(~among(t[section][name], options), f"{section}.{name}")) for rule, (section, name, options) in controlled.items()],
        ("R13", ERROR, F.when(all_of(*[among(view(v), VIEW_STATUSES) for v in VIEWS]), no_parts()).otherwise(lacking(VIEWS, keys_in(views)))),
        *[("R14", ERROR, broken(~among(view(v), VIEW_STATUSES), v)) for v in VIEWS],
        ("R15", ERROR, broken(~among(view("alignment_status"), ALIGNMENT_STATUSES), "alignment_status")),
        ("R16", ERROR, broken(issues.isNull(), "unresolved_issues")),
        ("R17", ERROR, broken(among(t["dataset_id"], framed) & ~among(t["perception"]["framework"], (FRAMEWORK,)), "perception.framework")),
        ("R33", ERROR, broken(~share(t["harmonisation_potential"]["score"]), "score")),
        ("R42_keys", ERROR, F.when(whole, no_parts()).otherwise(beyond(keys, SECTIONS))),
    ]


_STATUS = {"status": lambda x: among(x["status"], LEVEL_STATUSES), "note": lambda x: given(x["note"])}


def noted(x: Column) -> Column:
    return among(x["status"], LEVEL_STATUSES) & surely(x["note"])


def level_rules(r: Column) -> list[Rule]:
    levels = r["harmonisation"]["levels"]
    return [("R05", ERROR, lacking(LEVELS, keys_in(levels))), *by_key("R06", F.map_entries(levels), _STATUS), ("R42_levels", ERROR, beyond(keys_in(levels), LEVELS))]


def sound_levels(t: Column) -> Column:
    return each_key(t["harmonisation"]["levels"], LEVELS, noted)


def checklist_rules(r: Column) -> list[Rule]:
    return by_name("R07", r["harmonisation"]["checklist"], lambda x: x["item"], _STATUS)


def sound_checklist(t: Column) -> Column:
    return all_pass(t["harmonisation"]["checklist"], noted)


def item_rules(r: Column) -> list[Rule]:
    paq, told = r["perception"]["iso_12913"]["paq"], told_in(r)
    items, keys = F.map_entries(paq), keys_in(paq)
    return [
        ("R18", ERROR, beyond(keys, ITEMS)),
        ("R19", WARNING, lacking(ITEMS, keys)),
        *by_key("R20", items, {"value": lambda x: x["value"].isNotNull(), "source": lambda x: x["original_field"].isNotNull(), "type": lambda x: among(x["value_type"], ITEM_TYPES)}),
        ("R21", WARNING, each(items, lambda e: e["value"].isNotNull() & plain(e["value"]["value"]).isNull() & ~F.array_contains(told, F.concat(F.lit(ITEM_PATH), e["key"])), lambda e: e["key"])),
        ("R22", ERROR, broken(F.arrays_overlap(keys, named(COORDINATES)), "paq")),
    ]


def sound_items(t: Column) -> Column:
    return each_key(t["perception"]["iso_12913"]["paq"], ITEMS, lambda x: ~F.is_variant_null(x["value"]) & x["value"].isNotNull() & x["original_field"].isNotNull() & among(x["value_type"], ITEM_TYPES))


def coordinate_rules(r: Column) -> list[Rule]:
    derived = r["perception"]["iso_12913"]["derived_coordinates"]

    def coordinate(name: str) -> list[Rule]:
        x = F.try_element_at(derived, F.lit(name))
        there, whole = F.array_contains(keys_in(derived), name), given(x["method"]) & given(x["source"])
        return [("R24_object", ERROR, broken(there & x.isNull(), name)), ("R24_method", ERROR, broken(there & x.isNotNull() & ~whole, name)),
                ("R24_type", ERROR, broken(there & x.isNotNull() & whole & ~among(x["value_type"], ("derived_coordinate",)), name))]

    return [("R23", ERROR, F.array_sort(F.array_intersect(keys_in(derived), named(ITEMS)))), *[x for c in COORDINATES for x in coordinate(c)]]


def sound_coordinates(t: Column) -> Column:
    derived = t["perception"]["iso_12913"]["derived_coordinates"]
    return derived.isNull() | each_key(derived, COORDINATES, lambda x: surely(x["method"]) & surely(x["source"]) & among(x["value_type"], ("derived_coordinate",)))


def missing_rules(r: Column) -> list[Rule]:
    return by_name("R25", r["missingness"], lambda x: x["field"], {"status": lambda x: among(x["status"], MISSING_STATUSES)})


def sound_missing(t: Column) -> Column:
    return all_pass(t["missingness"], lambda x: among(x["status"], MISSING_STATUSES))


def seen_rules(r: Column) -> list[Rule]:
    unseen = among(r["visual"]["type"], ("none", "unknown")) | ~given(r["visual"]["asset"])
    return [("R29", ERROR, broken(unseen & ~F.arrays_overlap(told_in(r), named(("visual", "visual.asset"))), "visual"))]


def sound_seen(t: Column) -> Column:
    return surely(t["visual"]["asset"]) & ~among(t["visual"]["type"], ("none", "unknown"))


def provenance_rules(r: Column) -> list[Rule]:
    return [
        *by_name("R26", r["provenance"], lambda x: x["source_type"], {"source": lambda x: among(x["source_type"], SOURCES), "note": lambda x: given(x["note"])}),
        ("R27", ERROR, broken(~given(part(F.col("_doc"), "provenance")), "provenance")),
    ]


def sound_provenance(t: Column) -> Column:
    return ~no_entry(t["provenance"]) & all_pass(t["provenance"], lambda x: among(x["source_type"], SOURCES) & surely(x["note"]))


def feature_rules(r: Column) -> list[Rule]:
    method = {"method": lambda x: given(x["method"]) | given(x["provenance"])}
    return [
        *[x for g in FEATURE_GROUPS for x in by_name("R30", F.try_element_at(r["features"], F.lit(g)), lambda x: x["name"], method)],
        ("R42_features", ERROR, beyond(keys_in(r["features"]), FEATURE_GROUPS)),
    ]


def sound_features(t: Column) -> Column:
    groups = t["features"]
    good = lambda x: surely(x["method"]) | surely(x["provenance"])
    return (F.size(F.array_except(keys_in(groups), named(FEATURE_GROUPS))) < 1) & all_of(*[all_pass(F.try_element_at(groups, F.lit(g)), good) for g in FEATURE_GROUPS])


def graph_rules(r: Column) -> list[Rule]:
    nodes, edges = r["knowledge_graph"]["nodes"], r["knowledge_graph"]["edges"]

    def ends(e: Column) -> Column:
        known = lambda side: F.array_contains(r["_ids"], F.coalesce(e[side], F.lit("null")))
        return known("source") & known("target")

    return [
        ("R31_list", ERROR, broken(no_entry(nodes), "nodes")),
        *by_name("R31", nodes, lambda x: plain(x["id"]), {"fields": lambda x: given(x["id"]) & given(x["type"]) & given(x["label"])}),
        ("R32_list", ERROR, broken(no_entry(edges), "edges")),
        *by_name("R32", edges, lambda x: x["target"], {"ends": ends, "relation": lambda x: given(x["relation"])}),
        ("R42_node_type", ERROR, each(nodes, lambda n: given(n["type"]) & ~one_of(n["type"], NODE_TYPES), lambda n: plain(n["type"]))),
        ("R42_relation", ERROR, each(edges, lambda e: given(e["relation"]) & ~one_of(e["relation"], RELATIONS), lambda e: plain(e["relation"]))),
    ]


def with_ids(r: Column) -> Column:
    """The section of the graph with the ids of its nodes, found once for all edges."""
    ids = F.transform(F.filter(r["knowledge_graph"]["nodes"], F.isnotnull), lambda n: F.coalesce(plain(n["id"]), F.lit("null")))
    return F.struct(r["knowledge_graph"].alias("knowledge_graph"), F.coalesce(ids, no_parts()).alias("_ids"))


def potential_rules(r: Column) -> list[Rule]:
    parts = r["harmonisation_potential"]["components"]
    return [
        ("R34_list", ERROR, broken(no_entry(parts), "components")),
        *by_name("R34", parts, lambda x: plain(x["name"]), {"score": lambda x: share(x["score"]), "status": lambda x: among(x["status"], LEVEL_STATUSES)}),
        ("R42_component", ERROR, each(parts, lambda c: c.isNotNull() & ~(given(c["name"]) & given(c["reason"])), lambda c: plain(c["name"]))),
    ]


def sound_graph(t: Column) -> Column:
    nodes, edges = t["knowledge_graph"]["nodes"], t["knowledge_graph"]["edges"]
    typed = all_pass(nodes, lambda n: surely(n["id"]) & surely(n["label"]) & among(n["type"], NODE_TYPES))
    related = all_pass(edges, lambda e: e["source"].isNotNull() & e["target"].isNotNull() & among(e["relation"], RELATIONS))
    return ~no_entry(nodes) & ~no_entry(edges) & typed & related & all_of(*[F.size(F.array_except(edges[side], nodes["id"])) < 1 for side in ("source", "target")])


def sound_potential(t: Column) -> Column:
    parts = t["harmonisation_potential"]["components"]
    return ~no_entry(parts) & all_pass(parts, lambda c: surely(c["name"]) & surely(c["reason"]) & among(c["status"], LEVEL_STATUSES) & share(c["score"]))


#: Groups of rules: whether the texts tell that they are kept, the sections that they read, and the rules.
GROUPS = {
    "levels": (sound_levels, ("harmonisation",), level_rules), "checklist": (sound_checklist, ("harmonisation",), checklist_rules),
    "items": (sound_items, ("perception", "missingness"), item_rules), "coordinates": (sound_coordinates, ("perception",), coordinate_rules),
    "missing": (sound_missing, ("missingness",), missing_rules), "seen": (sound_seen, ("visual", "missingness"), seen_rules),
    "provenance": (sound_provenance, ("provenance",), provenance_rules), "features": (sound_features, ("features",), feature_rules),
    "graph": (sound_graph, ("knowledge_graph",), graph_rules), "potential": (sound_potential, ("harmonisation_potential",), potential_rules)}


def surely_sound(group: str) -> Column:
    """Whether the texts of an opened() record tell that it breaks no rule of a group; its rules decide about all others."""
    return F.coalesce(GROUPS[group][0](F.col("_t")), F.lit(False))


def sample_found(framed: tuple[str, ...]) -> Column:
    """The findings of an opened() sample record."""

    def looked_into(group: str) -> Column:
        _, sections, rules = GROUPS[group]
        r = F.array(F.try_variant_get("_doc", "$", shape(*sections)))
        once = F.transform(r, with_ids) if group == "graph" else r
        return F.flatten(F.flatten(F.transform(once, lambda r: F.array(*[marked(*x) for x in rules(r)]))))

    return F.concat(findings_of(text_rules(framed)), *[F.when(surely_sound(g), no_findings()).otherwise(looked_into(g)) for g in GROUPS])


def no_findings() -> Column:
    return F.array().cast(FINDINGS)


def marked(rule: str, severity: str, parts: Column) -> Column:
    return F.transform(parts, lambda p: F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), p.alias("part")))


def findings_of(rules: list[Rule]) -> Column:
    """All findings of the rules. Parts are marked only where there are some: a transform is interpreted, with all below it."""
    return F.flatten(F.array(*[F.when(F.size(parts) > 0, marked(rule, severity, parts)).otherwise(no_findings()) for rule, severity, parts in rules]))


def spread(df: DataFrame, found: Column) -> DataFrame:
    """row_key, record_id, severity, rule and part of every finding of df(row_key, record_id, ...).

    Findings are a projection of their own, which is compiled; inside the explode they would be interpreted. It is an outer
    one, as an inner one makes a filter of the same rules, which is moved below and looks at them a second time.
    """
    rows = df.select("row_key", "record_id", found.alias("_found"))
    return rows.select("row_key", "record_id", F.explode_outer("_found").alias("f")).filter("f IS NOT NULL").select("row_key", "record_id", "f.severity", "f.rule", "f.part")


def exploded(df: DataFrame, rules: list[Rule]) -> DataFrame:
    return spread(df, findings_of(rules))


def parsed(docs: DataFrame) -> DataFrame:
    """docs(row_key, value) with the value as a variant, null where it is no JSON text."""
    return docs.select("row_key", F.try_parse_json("value").alias("_doc"))


def sample_findings(docs: DataFrame, framed: tuple[str, ...] = ()) -> DataFrame:
    """Findings of sample records docs(row_key, value): row_key, record_id, severity, rule, part.

    record_id is the record's sample_id, else its dataset_id, else <unknown>. A text that is no JSON object breaks rule
    JSON alone, a record of another type than sample R35 alone. A null value is no JSON object; an empty table has no
    findings. JSON with NaN or repeated keys counts as no JSON.
    """
    whole = F.col("_keys").isNotNull()
    label = F.coalesce(*[F.when(given_at(c), F.col("_t")[c]) for c in IDS], F.lit("<unknown>"))
    other = findings_of([("JSON", ERROR, broken(~whole, "record")), ("R35", ERROR, broken(whole, "record_type"))])
    found = F.when(among(F.col("_t")["record_type"], ("sample",)), sample_found(framed)).otherwise(other)
    return spread(opened(parsed(docs)).withColumn("record_id", label), found)


def mapping_findings(docs: DataFrame) -> DataFrame:
    """Findings of mapping specs docs(row_key, value), as of sample_findings(); parts of mappings are numbered from 1."""
    r, listed = F.col("_r"), F.col("_r")["mappings"]
    opened_docs = parsed(docs).select("row_key", F.try_variant_get("_doc", "$", MAPPING).alias("_r"), F.try_variant_get("_doc", "$.mappings", f"array<{KEYS}>").alias("_keys"))
    numbered = F.transform(listed, lambda m, i: F.struct((i + 1).cast("string").alias("n"), m.alias("m")))
    gone = F.transform("_keys", lambda k, i: F.struct((i + 1).cast("string").alias("n"), F.array_except(named(MAPPING_FIELDS), F.coalesce(F.map_keys(k), no_parts())).alias("gone")))
    checks = {"confidence": ("mapping_confidence", CONFIDENCES), "evidence": ("evidence_type", EVIDENCE), "review": ("review_status", REVIEWS)}
    rows = F.col("_rows")
    rules: list[Rule] = [
        ("R36_framework", ERROR, broken(~among(r["semantic_framework"], (FRAMEWORK,)), "semantic_framework")),
        ("R36_scope", ERROR, broken(~among(r["harmonisation_scope"], (SCOPE,)), "harmonisation_scope")),
        ("R36_list", ERROR, broken(F.coalesce(F.size(listed) < 1, F.lit(True)), "mappings")),
        ("R37_fields", ERROR, each(F.col("_gone"), lambda x: F.size(x["gone"]) > 0, lambda x: F.concat(x["n"], F.lit(":"), F.array_join(F.array_sort(x["gone"]), ",")))),
        *[(f"R37_{k}", ERROR, each(rows, lambda x, f=field, o=options: ~among(x["m"][f], o), lambda x: x["n"])) for k, (field, options) in checks.items()],
        ("R37_examples", ERROR, each(rows, lambda x: x["m"]["source_column_examples"].isNull(), lambda x: x["n"])),
        ("R38", WARNING, F.when(F.size(listed) > 0, F.filter(named(ITEMS), lambda i: ~F.coalesce(F.array_contains(listed["target_field"], F.concat(F.lit(ITEM_PATH), i)), F.lit(False)))).otherwise(no_parts())),
    ]
    label = F.coalesce(r["dataset_id"], F.col("row_key").cast("string"))
    return exploded(opened_docs.withColumns({"_rows": numbered, "_gone": gone, "record_id": label}), rules)


def checklist_findings(docs: DataFrame) -> DataFrame:
    """Findings of checklists docs(row_key, value): one list of datasets each; record_id is the dataset's."""
    doc = parsed(docs).withColumn("_sets", part(F.col("_doc"), "datasets"))
    none = exploded(doc.withColumn("record_id", F.col("row_key").cast("string")), [("R39_datasets", ERROR, broken(~is_list(F.col("_sets")) | ~given(F.col("_sets")), "datasets"))])
    sets = doc.select("row_key", F.explode(entries(F.col("_sets"))).alias("_set"))
    items = part(F.col("_set"), "items")
    performed = F.exists(entries(items), lambda i: one_of(part(i, "status"), ("not_performed",)))
    rules: list[Rule] = [
        ("R39_items", ERROR, broken(~given(items), "items")),
        ("R39_not_performed", WARNING, broken(~performed, "items")),
        ("R39_status", ERROR, each(entries(items), lambda i: ~one_of(part(i, "status"), LEVEL_STATUSES), lambda i: plain(part(i, "item")))),
    ]
    label = F.coalesce(plain(part(F.col("_set"), "dataset_id")), F.lit("<unknown>"))
    return none.unionByName(exploded(sets.withColumn("record_id", label), rules))


def graph_model_findings(docs: DataFrame) -> DataFrame:
    """Findings of graph models docs(row_key, value): lists of types and views and a note must be there."""
    rules: list[Rule] = [("R40", ERROR, broken(~given(part(F.col("_doc"), f)), f)) for f in GRAPH_FIELDS]
    return exploded(parsed(docs).withColumn("record_id", F.col("row_key").cast("string")), rules)


def severity_totals(findings: DataFrame) -> DataFrame:
    """How many findings of each severity, none left out: severity, n."""
    counts = findings.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in (ERROR, WARNING)])
    return counts.unpivot([], [ERROR, WARNING], "severity", "n")
