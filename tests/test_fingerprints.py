"""A changed input makes exactly the stages below it stale, and names itself."""

import json

import pytest
from pyspark.sql import functions as F

from plateworks import fixed
from plateworks.functions import fingerprints as fp
from plateworks.operators import log, stages
from plateworks.sources import schemas

IDENTITIES = {"local": {"model": "m1", "image": {"format": "jpeg", "quality": 90}, "params": {"temperature": None}}}
PROMPT = "p1"
H = "hash-of-the-file"
FIELDS = '{"title": "Valve", "keywords": ["steel", "pipe"], "extra": {"b": 1, "a": [1, 2.5]}}'


def base_rows(spark, *changes):
    """One asset per change, with results of every stage; fingerprints are filled in afterwards."""
    made = [one(i, **change) for i, change in enumerate(changes or ({},))]
    df = stages.with_documents(spark.createDataFrame([row for row, _ in made], ", ".join(f"{k} {v}" for k, v in made[0][1].items())))
    return df.withColumns({s: F.from_json(f"{s}_text", schemas.MESSAGES[s]) for s in stages.STATE_SLOTS if s in schemas.MESSAGES})


def one(asset_id, **change):
    plan = {"title": "Valve", "description": "A valve in a pipe", "keywords": ["steel", "pipe"]}
    given = {
        "asset_id": asset_id, "file_hash": H, "file_size": 10, "source_path": "in/a.jpg", "ai_result": '{"subject":"valve"}', "qc_result": '{"passed":true,"errors":[],"warnings":[]}',
        "metadata_json": '{"state":"approved","completeness":"full","fields":' + FIELDS + ',"sources":{"builder_version":"metadata-v1","vision":{"event_id":5}}}',
        "readiness_profiles": "adobe-2026-09", "recommendation": "proceed", "plan": plan, "attested_kind": None, "attested_hash": H, "ids": {}}
    given.update(change)
    ids = {"normalize_evaluated": 1, "normalize_passed": 2, "qc": 3, "ai_passed": 5, "enhancement_assessed": 6, "readiness_evaluated": 9, "creative_advised": 10, "publication_evaluated": 11, "export_adobe": 12, **given["ids"]}
    messages = {
        "normalize_evaluated": {}, "normalize_passed": {"representation": "source"}, "ai_passed": {"provider": "local"}, "enhancement_assessed": {"decision": "enhancement_not_needed"},
        "readiness_evaluated": {"ready_for": ["adobe"], "platforms": {"adobe": {"profile": given["readiness_profiles"], "status": "ready", "checks": [], "export_plan": given["plan"]}}},
        "creative_advised": {"prompt_version": PROMPT, "features": {"recommendation": given["recommendation"]}}, "publication_evaluated": {"approved_for": ["adobe"]},
        "export_adobe": {"path": "export/a.jpg", "size_bytes": 7}}
    if given["attested_kind"]:
        messages["attested"], ids["attested"] = {"kind": given["attested_kind"], "file_hash": given["attested_hash"]}, 20
    columns = {"asset_id": "bigint", "file_hash": "string", "file_size": "bigint", "source_path": "string", "ai_result": "string", "qc_result": "string", "metadata_json": "string"}
    row = [given[c] for c in columns]
    for slot in stages.STATE_SLOTS:
        columns[f"{slot}_id"] = "bigint"
        row.append(ids.get(slot))
        if slot in schemas.MESSAGES:
            columns[f"{slot}_text"] = "string"
            row.append(json.dumps(messages[slot]) if slot in messages else None)
    columns |= {"source_actual_size": "bigint", "adobe_actual_size": "bigint", "shutterstock_actual_size": "bigint", "log_changed": "boolean"}
    row += [10, 7, None, False]
    return tuple(row), columns


def run(spark, stored=None, identities=None, **change):
    return run_all(spark, [change], stored, identities)[0]


def run_all(spark, changes, stored=None, identities=None):
    """The derived state per change. ``stored``: fingerprints and inputs as the results were written; by default those of the row itself."""
    rows = base_rows(spark, *changes)
    stored = stored or written(spark)
    put = {
        "normalize_evaluated": {"fingerprint": stored["fp_facts"]}, "normalize_passed": {"fingerprint": stored["fp_rep"]}, "qc_doc": {"input_fingerprint": stored["fp_qc"], "inputs": stored["qc_inputs"]},
        "ai_passed": {"input_fingerprint": stored["fp_vision"], "inputs": stored["vision_inputs"]}, "enhancement_assessed": {"fingerprint": stored["fp_enh"]}, "readiness_evaluated": {"fingerprint": stored["fp_readiness"]},
        "creative_advised": {"fingerprint": stored["fp_creative"]}, "publication_evaluated": {"fingerprint": stored["fp_publication"], "inputs": stored["publication_inputs"]},
        "export_adobe": {"inputs_fingerprint": stored["fp_export_adobe"]}}
    for column, fields in put.items():
        for name, value in fields.items():
            rows = rows.withColumn(column, F.when(F.col(column).isNotNull(), F.col(column).withField(name, F.lit(value))))
    return sorted(stages.derive(rows, identities or IDENTITIES, PROMPT).collect(), key=lambda r: r.asset_id)


_WRITTEN = {}


def written(spark):
    """Fingerprints of the unchanged row: readiness first, as publication and export name it."""
    if not _WRITTEN:
        def current(**stored):
            rows = base_rows(spark)
            for column, value in stored.items():
                rows = rows.withColumn(column, F.col(column).withField("fingerprint", F.lit(value)))
            rows = stages.with_fingerprints(rows, IDENTITIES, PROMPT).withColumns({"readiness_status": F.lit("current"), "readiness_reason": F.lit(None).cast("string"), "creative_review_status": F.lit("current")})
            return rows.withColumns({"fp_publication": fp.of(stages.publication_inputs()), "publication_inputs": fp.document(stages.publication_inputs() | {"readiness_event_id": F.lit(4)}),
                                     "qc_inputs": fp.document(fp.qc(F.col("fp_view"))), "vision_inputs": fp.document(fp.vision(F.col("fp_view"), "local", IDENTITIES["local"]))}).first().asDict()
        _WRITTEN.update(current(readiness_evaluated=current()["fp_readiness"]))
    return _WRITTEN


def stale(row):
    """Stages that are stale on their own account, not by inheritance."""
    own = {s: (row[f"{s}_own_status"] or row[f"{s}_status"], row[f"{s}_own_reason"] or row[f"{s}_reason"]) for s in stages.STAGES}
    return {s for s, (status, reason) in own.items() if status == "stale"} | ({"export"} if row["adobe_file"].reason == "FINGERPRINT_CHANGED" else set())


def test_nothing_changed_nothing_stale(spark):
    row = run(spark)
    assert stale(row) == set() and row.state == "ready_for_export" and row.publication_changed is None
    names = [f"fp_{n}" for n in ("facts", "rep", "view", "qc", "enh", "vision", "creative", "readiness", "publication", "export_adobe")]
    assert len({row[n] for n in names}) == 10 and all(row[n].startswith("sha256:") and len(row[n]) == 71 for n in names)


METADATA = '{"state":"approved","completeness":"full","fields":%s,"sources":{"builder_version":"metadata-v1","vision":{"event_id":5}}}'


CHANGES = [
    ({"metadata_json": METADATA % FIELDS.replace("Valve", "Pump")}, {"readiness"}),
    ({"metadata_json": METADATA % FIELDS.replace("2.5", "2.6")}, {"readiness"}),
    ({"metadata_json": METADATA % '{"keywords":["steel","pipe"],"extra":{"a":[1,2.5],"b":1},"title":"Valve"}'}, set()),  # order of members and spaces do not matter
    ({"metadata_json": METADATA % FIELDS.replace('["steel", "pipe"]', '["pipe", "steel"]')}, {"readiness"}),  # order of items does
    ({"ids": {"normalize_evaluated": 100, "normalize_passed": 101}}, {"readiness"}),
    ({"ids": {"source_invalid": 8}}, {"readiness"}),
    ({"attested_kind": "not_identifiable"}, {"readiness"}),
    ({"attested_kind": "not_identifiable", "attested_hash": "another file"}, set()),
    ({"attested_kind": "none"}, set()),
    ({"ai_result": '{"subject":"pump"}'}, {"creative_review"}),
    ({"recommendation": "skip_suggested"}, {"publication"}),
    ({"plan": {"title": "Valves", "keywords": ["steel", "pipe"]}}, {"export"}),
    ({"plan": {"title": "Valve", "description": "not part of the file", "keywords": ["steel", "pipe"]}}, set()),
    ({"qc_result": '{"passed":false}'}, {"readiness"}),
]


def test_a_changed_input_makes_exactly_its_stages_stale(spark):
    for row, (change, want) in zip(run_all(spark, [c for c, _ in CHANGES]), CHANGES):
        if want == {"creative_review"}:
            want = {"creative_review", "publication"}  # a recommendation that is not current is no advice
        assert stale(row) == want, change


def test_a_changed_file_makes_everything_below_stale(spark):
    row = run(spark, file_hash="other")
    assert stale(row) >= {"normalize", "qc", "vision", "enhancement", "readiness", "creative_review", "publication"} and row.qc_changed == ["view"] and row.vision_changed == ["view"]


@pytest.mark.parametrize("name, value, stage", [("VIEW_VERSION", "v2", {"qc", "vision", "enhancement", "creative_review", "publication", "export"}), ("READINESS_VERSION", "r9", {"readiness"}), ("ENHANCEMENT_RULES_VERSION", "e9", {"enhancement"}),
                                                ("PUBLICATION_POLICY_VERSION", "pp9", {"publication"}), ("EXPORT_VERSION", "x9", {"export"}), ("FACTS_VERSION", "f9", {"normalize"})])
def test_versions(spark, monkeypatch, name, value, stage):
    written(spark)
    monkeypatch.setattr(fixed, name, value)
    got = stale(run(spark))
    assert got - {"export"} == stage - {"export"}


def test_rules_profiles_and_identities_report_nested_changes(spark, monkeypatch):
    kept = dict(written(spark))
    assert run(spark, identities={"local": {**IDENTITIES["local"], "image": {"format": "jpeg", "quality": 80}}}).vision_changed == ["image"]
    assert run(spark, identities={"local": {**IDENTITIES["local"], "params": {"temperature": 0}}}).vision_changed == ["params"]
    assert run(spark, identities={"remote": IDENTITIES["local"]}).vision_reason == "UNKNOWN_PROVIDER"
    older = json.loads(kept["publication_inputs"])
    older["profiles"]["adobe"], older["readiness_event_id"], older["advice"]["recommendation"] = "adobe-2026-03", 99, "attention"
    row = run(spark, stored={**kept, "publication_inputs": json.dumps(older), "fp_publication": "sha256:older"})
    assert row.publication_changed == ["advice", "profiles"] and row.publication_status == "stale"
    rules = {**fixed.QC_RULES, "edge_dark": 1}
    row = run(spark, stored={**kept, "qc_inputs": json.dumps({"rules": rules, "view": kept["fp_view"]}), "fp_qc": "sha256:older"})
    assert row.qc_changed == ["rules"]


def test_members_compare_at_any_depth(spark):
    pairs = [('{"a":{"x":1,"y":[1,{"z":2}]},"b":null}', '{"a":{"y":[1,{"z":2}],"x":1}}', []), ('{"a":{"x":1}}', '{"a":{"x":2}}', ["a"]), ('{"a":1,"c":"1"}', '{"a":1.0,"c":1}', ["c"]), ("[1]", '{"a":1}', ["a"]),
             ("not json", '{"a":1}', ["a"]), (None, "{}", []), ('{"é":"ü \\"q\\""}', '{"é":"ü \\"q\\""}', []), ("{}", '{"skip":1,"z":0,"b":0}', ["b", "z"])]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    got = {r.i: r.d for r in df.select("i", fp.changed_members(F.col("a"), F.col("b"), ("skip",)).alias("d")).collect()}
    assert got == {i: want for i, (*_, want) in enumerate(pairs)}


EMPTY = [(None, "missing", "NOT_CHECKED"), ("{}", "missing", "NOT_CHECKED"), (" { } ", "missing", "NOT_CHECKED"), ("broken", "missing", "NOT_CHECKED"), ('{"passed":true}', "current", None)]


def test_an_empty_qc_document_is_no_result(spark):
    for row, (text, status, reason) in zip(run_all(spark, [{"qc_result": t} for t, *_ in EMPTY]), EMPTY):
        assert (row.qc_own_status or row.qc_status, row.qc_own_reason or row.qc_reason) == (status, reason), text


def test_slots_hold_what_fingerprints_need():
    assert {"source_invalid", "attested", "normalize_evaluated"} <= set(stages.STATE_SLOTS) <= set(log.SLOTS)
