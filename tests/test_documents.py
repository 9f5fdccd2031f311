"""Nested documents of many lines, what is rejected, and rules of sites."""

import json

from floodspark.functions import site_checks
from floodspark.sources import documents


def site(**changes):
    number = lambda x, status="measured": {"value": x, "status": status}
    domain = lambda box, metres, inflow: {"bbox": number(box), "grid_resolution": number(metres), "inflow": {"from": inflow}}
    dam = lambda name, **more: {"id": name, "kind": "embankment_dam", "breach_inputs": {"breach_height": number(10), "dam_height": number(12)}} | more
    doc = {
        "schema_version": 1, "site": {"id": "v"}, "dams": [dam("a"), dam("b", triggered_by="a", trigger={"stage_m": 1})], "cascade": {"approach": "two_stage_imposed"},
        "domains": {"far_field": domain([0, 0, 9, 9], 20, "a"), "near_field": domain([1, 1, 9, 9], 10, "far_field")},
        "events": [{"id": "e", "breach_times": {"a": 0}}], "simulation": {"sph": {"scenarios": ["v__s001", "v__n_x"]}},
    }
    return doc | changes


def test_documents_of_many_lines_and_rejects(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps(site(), indent=2))
    (tmp_path / "cut.json").write_text(json.dumps(site(), indent=2)[:200])
    (tmp_path / "type.json").write_text(json.dumps(site(dams="none")))
    (tmp_path / "key.json").write_text(json.dumps(site(site={"name": "x"})))
    (tmp_path / "blank.json").write_text(" \n")
    (tmp_path / "array.json").write_text("[1, 2]")
    read = documents.documents(spark, str(tmp_path), "site")
    assert [r.site.id for r in documents.accepted(read).collect()] == ["v"]
    why = {r.file.rsplit("/", 1)[1]: r.reason for r in documents.rejected(read).collect()}
    assert why == {"cut.json": "not a document of this kind", "type.json": "not a document of this kind", "key.json": "no site.id", "array.json": "not a document of this kind"}
    assert site_checks.site_violations(documents.accepted(read)).count() == 0 == documents.documents(spark, str(tmp_path / "blank.json"), "site").count()


def test_each_rule_of_sites(spark, tmp_path):
    good = site()
    a, b = good["dams"]
    null = {"value": None, "status": "measured"}
    cases = {
        "no_dams": site(dams=[], events=[]), "duplicate_id": site(dams=[a, b, b]), "triggered_by_not_before": site(dams=[a, b | {"triggered_by": "b"}]), "trigger_without_triggered_by": site(dams=[a | {"trigger": {"stage_m": 1}}, b]),
        "triggered_without_cascade": site(cascade=None), "two_stage_without_trigger": site(dams=[a, b | {"trigger": None}]), "concrete_with_equations": site(dams=[a | {"kind": "concrete_dam"}, b]),
        "no_imposed_ranges": site(dams=[a | {"equations_applicable": False}, b]), "warn_breach_over_dam": site(dams=[a | {"breach_inputs": {"breach_height": {"value": 13, "status": "measured"}, "dam_height": {"value": 12, "status": "measured"}}}, b]),
        "unknown_dam": site(events=[{"id": "e", "breach_times": {"z": 0}}]), "other_site": site(simulation={"sph": {"scenarios": ["w__s001"]}}), "unknown_shape": site(simulation={"sph": {"scenarios": ["v__s1"]}}),
        "null_without_placeholder": site(dams=[a | {"breach_inputs": {"average_width": null}}, b]),
    }
    far, near = good["domains"]["far_field"], good["domains"]["near_field"]
    cases["outside_far_field"] = site(domains={"far_field": far, "near_field": near | {"bbox": {"value": [1, 1, 10, 9], "status": "measured"}}})
    cases["does_not_divide"] = site(domains={"far_field": far, "near_field": near | {"grid_resolution": {"value": 8, "status": "measured"}}})
    cases["unknown_inflow"] = site(domains={"far_field": far | {"inflow": {"from": "far_field"}}, "near_field": near})
    for name, doc in cases.items():
        doc["site"] = {"id": name}
        if name != "other_site" and name != "unknown_shape":
            doc["simulation"] = None
        else:
            doc["simulation"]["sph"]["scenarios"] = [s.replace("v__", f"{name}__") for s in doc["simulation"]["sph"]["scenarios"]]
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=1))
    sites = documents.accepted(documents.documents(spark, str(tmp_path), "site"))
    got = {}
    for r in site_checks.site_violations(sites).collect():
        got.setdefault(r.site_id, set()).add(r.rule)
    assert got.pop("no_dams") == {"no_dams", "unknown_inflow"}
    assert got == {name: {name} for name in cases if name != "no_dams"}


def test_run_records_methods_and_placeholders(spark, tmp_path):
    (tmp_path / "run.json").write_text(json.dumps({"run_id": "r", "wall_time_s": 12.5, "thresholds": {"extent_m": 0.3}, "caveats": ["c"], "started_at": "2024-01-02T03:04:05Z", "more": {"x": 1}}, indent=2))
    r = documents.accepted(documents.documents(spark, str(tmp_path), "run_meta")).first()
    assert (r.run_id, r.wall_time_s, r.thresholds.extent_m, r.caveats, r.started_at.minute) == ("r", 12.5, 0.3, ["c"], 4)
    folder = tmp_path / "b"
    folder.mkdir()
    (folder / "b.json").write_text(json.dumps({"site_id": "s", "dams": [{"dam_id": "a", "parameters": {"width_m": {"methods": {"F8": {"value": 3.0}, "XZ9": {"value": None, "status": "blocked", "reason": "x"}}}}}]}, indent=2))
    rows = documents.method_rows(documents.accepted(documents.documents(spark, str(folder), "breach_params"))).collect()
    assert sorted((r.output, r.method, r.value, r.status, r.reason) for r in rows) == [("width_m", "F8", 3.0, "ok", None), ("width_m", "XZ9", None, "blocked", "x")]
    folder = tmp_path / "s"
    folder.mkdir()
    doc = site()
    doc["dams"][1]["breach_inputs"]["dam_height"] = {"value": None, "status": "placeholder"}
    (folder / "s.json").write_text(json.dumps(doc))
    sites = documents.accepted(documents.documents(spark, str(folder), "site"))
    assert site_checks.placeholders(sites).first().paths == ["dams[1].breach_inputs.dam_height"] and site_checks.site_violations(sites).count() == 0
