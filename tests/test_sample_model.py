"""Rules of sample records against a plain model, over records with several faults each."""

import json
import random
from collections import Counter

from earshot.functions.scores import ITEMS
from earshot.operators import samples as s
from earshot.operators.samples import sample_findings
from earshot.sources.documents import GONE, sound_sample

VALUES = [GONE, None, "", "x", "unknown", "visual", 0, 1, 0.5, 1.5, -1, True, False, [], {}, ["a"], [7, {}], {"status": "unknown"}, {"id": 1, "name": "n", "note": "x"}, [{"field": "visual"}], [{"status": "open", "source": "sample"}]]


def paths(value, at=()):
    """All places in a record below its top."""
    inner = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    for k, v in inner:
        yield (*at, k)
        yield from paths(v, (*at, k))


def mutated(rng):
    record = json.loads(json.dumps(sound_sample()).replace("KEY", "s1"))
    for _ in range(rng.randint(1, 5)):
        *above, last = rng.choice(list(paths(record)))
        node = record
        for k in above:
            node = node[k]
        value = rng.choice(VALUES)
        if value is GONE:
            del node[last]
        else:
            node[last] = json.loads(json.dumps(value))
        if isinstance(node, dict) and rng.random() < 0.15:
            node[rng.choice(["more", "calm", "pleasantness", "visual", "type"])] = rng.choice([1, None, {}, "Thing"])
    return record


def said(v):
    """A value as a finding names it; members of objects in the order of their names."""
    return v if v is None or isinstance(v, str) else json.dumps(v, separators=(",", ":"), sort_keys=True)


def obj(v):
    return v if isinstance(v, dict) else {}


def seq(v):
    return v if isinstance(v, list) else []


def model(r, framed):
    out = Counter()

    def add(rule, part, severity="error"):
        out[severity, rule, part] += 1

    def bad(failed, rule, part, severity="error"):
        if failed:
            add(rule, part, severity)

    def names(rule, found, severity="error"):
        bad(found, rule, ",".join(sorted(found)), severity)

    def controlled(rule, section, field, options):
        bad(said(obj(r.get(section)).get(field)) not in options, rule, f"{section}.{field}")

    def every(rule, pairs, **checks):
        for name, v in pairs:
            if not isinstance(v, dict):
                add(f"{rule}_object", name)
            for check, ok in checks.items():
                bad(isinstance(v, dict) and not ok(v), f"{rule}_{check}", name)

    def called(listed, field):
        return [("?" if obj(x).get(field) is None else said(x[field]), x) for x in listed]

    def within(x):
        return isinstance(x, (bool, int, float)) and 0 <= x <= 1

    if said(r.get("record_type")) != "sample":
        return Counter({("error", "R35", "record_type"): 1})
    status = lambda options: lambda v: said(v.get("status")) in options
    noted = lambda v: bool(v.get("note"))
    names("R01", set(s.SECTIONS) - set(r))
    names("R42_keys", set(r) - set(s.SECTIONS))
    bad(not r.get("dataset_id"), "R02", "dataset_id")
    bad(not r.get("sample_id"), "R03", "sample_id")
    harmony = obj(r.get("harmonisation"))
    bad(said(harmony.get("scope")) != "schema_level", "R04", "harmonisation.scope")
    levels = obj(harmony.get("levels"))
    names("R05", set(s.LEVELS) - set(levels))
    names("R42_levels", set(levels) - set(s.LEVELS))
    every("R06", levels.items(), status=status(s.LEVEL_STATUSES), note=noted)
    every("R07", called(seq(harmony.get("checklist")), "item"), status=status(s.LEVEL_STATUSES), note=noted)
    for rule, section, field, options in (("R08", "access", "status", s.ACCESS_STATUSES), ("R09", "study", "environment_type", s.ENVIRONMENTS), ("R10", "study", "setting", s.SETTINGS),
                                          ("R11", "audio", "channel_type", s.CHANNELS), ("R12", "visual", "type", s.VISUALS), ("R28", "validation", "status", s.VALIDATION_STATUSES)):
        controlled(rule, section, field, options)
    views = obj(r.get("alignment"))
    names("R13", set(s.VIEWS) - set(views))
    for v in s.VIEWS:
        bad(said(views.get(v)) not in s.VIEW_STATUSES, "R14", v)
    bad(said(views.get("alignment_status")) not in s.ALIGNMENT_STATUSES, "R15", "alignment_status")
    bad(not isinstance(views.get("unresolved_issues"), list), "R16", "unresolved_issues")
    felt = obj(r.get("perception"))
    bad(said(r.get("dataset_id")) in framed and said(felt.get("framework")) != "ISO_12913", "R17", "perception.framework")
    told = {said(obj(m).get("field")) for m in seq(r.get("missingness"))}
    items, derived = (obj(obj(felt.get("iso_12913")).get(k)) for k in ("paq", "derived_coordinates"))
    names("R18", set(items) - set(ITEMS))
    names("R19", set(ITEMS) - set(items), "warning")
    every("R20", items.items(), value=lambda v: "value" in v, source=lambda v: "original_field" in v, type=lambda v: said(v.get("value_type")) in s.ITEM_TYPES)
    for k, v in items.items():
        bad(isinstance(v, dict) and v.get("value") is None and f"perception.iso_12913.paq.{k}" not in told, "R21", k, "warning")
    bad({"pleasantness", "eventfulness"} & set(items), "R22", "paq")
    for k in set(ITEMS) & set(derived):
        add("R23", k)
    for c in {"pleasantness", "eventfulness"} & set(derived):
        v = derived[c]
        if not isinstance(v, dict):
            add("R24_object", c)
        elif not (v.get("method") and v.get("source")):
            add("R24_method", c)
        else:
            bad(v.get("value_type") != "derived_coordinate", "R24_type", c)
    every("R25", called(seq(r.get("missingness")), "field"), status=status(s.MISSING_STATUSES))
    every("R26", called(seq(r.get("provenance")), "source_type"), source=lambda v: said(v.get("source_type")) in s.SOURCES, note=noted)
    bad(not r.get("provenance"), "R27", "provenance")
    seen = obj(r.get("visual"))
    bad((said(seen.get("type")) in ("none", "unknown") or not seen.get("asset")) and not told & {"visual", "visual.asset"}, "R29", "visual")
    groups = obj(r.get("features"))
    for g in s.FEATURE_GROUPS:
        every("R30", called(seq(groups.get(g)), "name"), method=lambda v: bool(v.get("method") or v.get("provenance")))
    names("R42_features", set(groups) - set(s.FEATURE_GROUPS))
    graph, potential = obj(r.get("knowledge_graph")), obj(r.get("harmonisation_potential"))
    for rule, section, field in (("R31", graph, "nodes"), ("R32", graph, "edges"), ("R34", potential, "components")):
        bad(not seq(section.get(field)), f"{rule}_list", field)
    nodes, edges, parts = seq(graph.get("nodes")), seq(graph.get("edges")), seq(potential.get("components"))
    text = lambda v: "null" if v is None else said(v)
    ids = {text(n.get("id")) for n in nodes if isinstance(n, dict)}
    every("R31", called(nodes, "id"), fields=lambda n: all(n.get(f) for f in ("id", "type", "label")))
    every("R32", called(edges, "target"), ends=lambda e: text(e.get("source")) in ids and text(e.get("target")) in ids, relation=lambda e: bool(e.get("relation")))
    bad(not within(potential.get("score")), "R33", "score")
    every("R34", called(parts, "name"), score=lambda c: within(c.get("score")), status=status(s.LEVEL_STATUSES))
    for rule, listed, field, options in (("R42_node_type", nodes, "type", s.NODE_TYPES), ("R42_relation", edges, "relation", s.RELATIONS)):
        for x in map(obj, listed):
            bad(x.get(field) and said(x[field]) not in options, rule, said(x.get(field)))
    for name, c in called(parts, "name"):
        bad(isinstance(c, dict) and not (c.get("name") and c.get("reason")), "R42_component", name)
    return out


def test_many_faults_in_a_record_match_a_plain_model(spark):
    rng = random.Random(11)
    records = [mutated(rng) for _ in range(2000)]
    docs = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "row_key long, value string").repartition(8)
    got = [Counter() for _ in records]
    for f in sample_findings(docs, ("SURVEY",)).collect():
        got[f.row_key][f.severity, f.rule, f.part] += 1
    differ = [(i, got[i] - want, want - got[i]) for i, want in ((i, model(r, ("SURVEY",))) for i, r in enumerate(records)) if got[i] != want]
    assert not differ, (len(differ), differ[:5])
    rules = {rule for g in got for _, rule, _ in g}
    assert len(rules) > 55 and max(map(len, got)) > 10
