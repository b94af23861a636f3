"""Searches over files written here; expectations are worked out by hand."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from ratelens.operators import catalog, search, summary
from ratelens.plans import flows
from ratelens.sources import files as sources
from ratelens.sources import mrf, sinks

A, B, C = 1316924913, 9999999999, 5555555555


def group(npis, tin="16-0960964"):
    return {"npi": npis, "tin": {"type": "ein", "value": tin}}


def ref(gid, *groups):
    return {"provider_group_id": gid, "provider_groups": list(groups)}


def price(rate, **more):
    return {"negotiated_rate": rate, "negotiated_type": "negotiated", "billing_class": "professional", "setting": "outpatient", "expiration_date": "2025-12-31"} | more


def item(code, rates, name="a visit", **more):
    return {"billing_code_type": "CPT", "billing_code": code, "name": name, "negotiation_arrangement": "ffs", "negotiated_rates": rates} | more


def rate(prices, refs=None, groups=None):
    return {"negotiated_prices": prices} | ({"provider_references": refs} if refs is not None else {}) | ({"provider_groups": groups} if groups is not None else {})


PLAN = {
    "reporting_entity_name": "A plan",
    "provider_references": [ref(302.257054942, group([A])), ref(302.100000001, group([B], "99-9999999")), ref(302.300000003, group([A, C], "55-5555555"))],
    "in_network": [
        item("99213", [rate([price(125.5, service_code=["11"], billing_code_modifier=[]), price(140.0, setting="inpatient", service_code=["21"], billing_code_modifier=["26"])], [302.257054942])]),
        item("99214", [rate([price(200.0)], [302.100000001])]),
        item("J0129", [rate([price(50.0)], [302.300000003])]),
        item("36415", [rate([price(12.75)], groups=[group([A])])]),
    ],
}


@pytest.fixture
def written(tmp_path, spark):
    def write(*bodies, zipped=True):
        rows = []
        for k, body in enumerate(bodies):
            text = body if isinstance(body, str) else json.dumps(body)
            path = tmp_path / f"{k}-{len(list(tmp_path.iterdir()))}.json.gz"
            path.write_bytes(gzip.compress(text.encode()) if zipped else text.encode())
            rows.append((k, str(path)))
        return spark.createDataFrame(rows, "file_seq int, source_file string")

    return write


def found(files, npis, single=False):
    raw = mrf.read_elements(files)
    refs, items = search.read_provider_references(raw), search.read_in_network(raw)
    return search.search_rates(refs, items, npis, search.single_pass_files(raw, npis) if single else None)


def rates(df):
    return sorted((r["billing_code"], r["negotiated_rate"]) for r in df.collect())


FOUR = [("36415", 12.75), ("99213", 125.5), ("99213", 140.0), ("J0129", 50.0)]


def test_one_number(written):
    rows = found(written(PLAN), [A]).collect()
    assert sorted((r["billing_code"], r["negotiated_rate"]) for r in rows) == FOUR
    assert {r["tin"]["value"] for r in rows if r["billing_code"] == "J0129"} == {"55-5555555"}
    inpatient = next(r for r in rows if r["setting"] == "inpatient")
    assert (inpatient["service_code"], inpatient["billing_code_modifier"]) == (["21"], ["26"])
    assert next(r for r in rows if r["negotiated_rate"] == 125.5)["billing_code_modifier"] == []
    assert next(r for r in rows if r["billing_code"] == "J0129")["service_code"] is None


def test_two_numbers_none_and_modes(written):
    files = written(PLAN, zipped=False)
    assert rates(found(files, [A, B, A])) == sorted([*FOUR, ("99214", 200.0)])
    assert rates(found(files, [1111111111])) == []
    assert rates(found(files, [A], single=True)) == FOUR


def test_files_are_apart_and_repeat(written):
    rows = found(written(PLAN, PLAN, PLAN), [A])
    assert rows.count() == 12 and rows.select("source_file").distinct().count() == 3
    twice = written(PLAN)
    twice = twice.unionByName(twice.withColumn("file_seq", F.lit(1)))
    assert found(twice, [A]).count() == 8
    assert summary.search_summary(found(twice, [A]), twice, [A, A]).first().asDict() == {"npis": [A, A], "searched_files": 2, "matched_files": 2, "rates": 8, "duration_seconds": 0.0}


def test_ids_belong_to_their_file_and_are_exact(written):
    one = {"provider_references": [ref(1, group([A]))], "in_network": [item("1", [rate([price(1.0)], [1])])]}
    two = {"provider_references": [ref(1, group([B]))], "in_network": [item("2", [rate([price(2.0)], [1])])]}
    assert rates(found(written(one, two), [A])) == [("1", 1.0)]
    near = {"provider_references": [ref(42.123456789, group([A])), ref(42.987654321, group([B]))], "in_network": [item("1", [rate([price(1.0)], [42.123456789])]), item("2", [rate([price(2.0)], [42.987654321])])]}
    assert rates(found(written(near), [A])) == [("1", 1.0)]


def test_nothing_is_deduplicated(written):
    body = {"provider_references": [ref(1, group([A, A])), ref(1, group([A]))], "in_network": [item("1", [rate([price(1.0), price(2.0)], [1, 1], [group([A])])])]}
    # Three listings of the number, reached by two equal ids, and one inline; each with two prices.
    assert found(written(body), [A]).count() == (3 * 2 + 1) * 2


def test_defaults_and_descriptions(written):
    body = {"in_network": [item("1", [{"provider_groups": [{"npi": [A]}], "negotiated_prices": [{"service_code": []}]}], name="", description="told")]}
    row = found(written(body), [A]).first()
    assert row["billing_code_description"] == "told" and row["negotiated_rate"] == 0.0 and row["setting"] == "" and row["tin"].asDict() == {"type": "", "value": ""}
    assert row["service_code"] == [] and row["billing_code_modifier"] is None


def test_elements_that_do_not_fit_are_dropped(written):
    bad = [ref("7", group([A])), ref(8, group([str(A)])), {"provider_groups": [group([A])]}, 5, ref(9, group([float(A)]))]
    body = {"provider_references": [*bad, ref(1, group([A]))], "in_network": [item("1", [rate([price(1.0)], [1])]), item("2", [rate([price("x")], [1])])]}
    text = json.dumps(body)
    assert rates(found(written(text), [A])) == [("1", 1.0)]


@pytest.mark.parametrize("cut", [1, 40, 300])
def test_broken_files_fail(written, cut):
    text = json.dumps(PLAN)[:-cut]
    files = written(text)
    with pytest.raises(Exception, match="cut off"):
        found(files, [A]).collect()
    assert [(r["ok"], r["reason"] != "") for r in catalog.validate_files(files).collect()] == [(False, True)]


def test_cut_gzip_fails(written, spark, tmp_path):
    path = tmp_path / "x.json.gz"
    path.write_bytes(gzip.compress(json.dumps(PLAN).encode())[:-20])
    files = spark.createDataFrame([(0, str(path))], "file_seq int, source_file string")
    assert [r["ok"] for r in catalog.validate_files(files).collect()] == [False]


def test_sections(written):
    assert rates(found(written({"in_network": None, "provider_references": []}), [A])) == []
    assert catalog.validate_files(written('{"in_network": 5}')).first()["reason"] == "in_network is not an array"
    assert catalog.validate_files(written("{}")).first()["ok"]
    counted = summary.file_counters(mrf.read_elements(written(PLAN | {"x": {"in_network": [1, "]}"]}})))
    assert sorted(map(tuple, counted.collect())) == [(0, "in_network", 4, 0), (0, "provider_references", 3, 0)]


def test_counters(written):
    body = PLAN | {"provider_references": [*PLAN["provider_references"], ref("x", group([A])), 5]}
    raw = mrf.read_elements(written(body))
    assert sorted(map(tuple, summary.file_counters(raw).collect())) == [(0, "in_network", 4, 0), (0, "provider_references", 5, 2)]
    watched, seen = summary.observed(raw)
    watched.collect()
    assert seen.get == {"refs_scanned": 5, "codes_scanned": 4}
    providers = search.matched_providers(search.read_provider_references(raw), [A])
    assert [tuple(r) for r in summary.npi_matches(providers).collect()] == [(0, 2)]
    assert [tuple(r) for r in summary.rates_found(found(written(PLAN), [A])).collect()] == [(0, 4)]


def test_single_pass_loses_what_it_must(written):
    inline = [item("1", [rate([price(1.0)], groups=[group([A])])])]
    unmatched = {"provider_references": [ref(1, group([B]))], "in_network": inline}
    none = {"in_network": inline}
    empty = {"provider_references": [], "in_network": inline}
    swapped = {"in_network": inline, "provider_references": [ref(1, group([A]))]}
    swapped_unmatched = {"in_network": inline, "provider_references": [ref(1, group([B]))]}
    for body, lost in ((unmatched, True), (none, True), (empty, False), (swapped, False), (swapped_unmatched, True)):
        assert found(written(body), [A]).count() == 1
        assert found(written(body), [A], single=True).count() == (0 if lost else 1)


def test_prefilter_items_index_and_many_targets(written, spark):
    raw = mrf.read_elements(written(PLAN))
    assert search.prefilter_raw(raw, [B]).filter("section = 'provider_references' AND pos >= 0").count() == 1
    assert search.prefilter_raw(raw, range(60)).count() == raw.count()
    refs, items = search.read_provider_references(raw), search.read_in_network(raw)
    assert sorted(r["billing_code"] for r in search.matching_items(refs, items, [A]).collect()) == ["36415", "99213", "J0129"]
    index = search.provider_index(search.matched_providers(refs, [A, C]))
    assert sorted((round(r["provider_group_id"], 3), len(r["providers"])) for r in index.collect()) == [(302.257, 1), (302.3, 2)]
    many = [A, *range(2_000_000_000, 2_000_000_100)]
    assert rates(search.search_rates(refs, items, many)) == FOUR
    assert rates(search.search_rates(refs, items, spark.createDataFrame([(n,) for n in many], "npi long"))) == FOUR


def test_data_source_sections_landing_and_results_agree(written, spark, tmp_path):
    files = written(PLAN)
    mrf.register(spark)
    by_format = spark.read.format("mrf").load(files.first()["source_file"])
    assert rates(search.search_rates(search.read_provider_references(by_format), search.read_in_network(by_format, 2), [A])) == FOUR
    raw = mrf.read_elements(files)
    sinks.split_sections(raw, str(tmp_path / "split"))
    back = sources.read_sections(spark, str(tmp_path / "split"))
    assert rates(search.search_rates(search.read_provider_references(back), search.read_in_network(back), [A])) == FOUR
    sinks.write_lines(raw, str(tmp_path / "lines"))
    lines = sources.read_line_folders(spark, str(tmp_path / "lines"))
    assert rates(search.search_rates(search.read_provider_references(lines), search.read_in_network(lines), [A])) == FOUR
    apart = [sources.read_lines(spark, [str(tmp_path / "lines" / "lines" / "file_seq=0" / f"section={s}")], s, 3, "a file") for s in mrf.SECTIONS]
    rows = search.search_rates(search.read_provider_references(apart[0]), search.read_in_network(apart[1]), [A])
    assert rates(rows) == FOUR and {r["source_file"] for r in rows.collect()} == {"a file"}
    sinks.land(raw, str(tmp_path / "landed"))
    assert rates(sinks.search_landed(spark, str(tmp_path / "landed"), [A])) == FOUR
    plan = sinks.search_landed(spark, str(tmp_path / "landed"), [A, B])._jdf.queryExecution().toString()
    assert "In(npi, [1316924913,9999999999])" in plan
    pruned = [x.split("PartitionFilters: ")[1] for x in plan.splitlines() if "FileScan" in x and "file_part" in x]
    assert any("dynamicpruning" in x for x in pruned), pruned
    results = search.search_rates(search.read_provider_references(raw), search.read_in_network(raw), [A])
    sinks.write_results(results, str(tmp_path / "results"))
    assert rates(sinks.read_results(spark, str(tmp_path / "results"))) == FOUR
    sinks.write_output(results, summary.search_summary(results, files, [A]), str(tmp_path / "output"))
    params, again = sinks.read_output(spark, str(tmp_path / "output"))
    assert rates(again) == FOUR and params.first().asDict() == {"npis": [A], "searched_files": 1, "matched_files": 1, "duration_seconds": 0.0}
    whole = json.loads(sinks.envelope(results, summary.search_summary(results, files, [A])).first()["json"])
    assert whole["search_params"]["matched_files"] == 1 and len(whole["results"]) == 4
    none = results.filter("false")
    assert json.loads(sinks.envelope(none, summary.search_summary(none, files, [A])).first()["json"])["results"] == []


def test_files_to_results_in_one_read(written, spark):
    twice = json.dumps(PLAN)[:-1] + ', "in_network": [' + json.dumps(item("36415", [rate([price(1.5)], groups=[group([A])])])) + "]}"
    files = written(PLAN, twice)
    rows = flows.search_files(files, [A])
    assert rates(rows) == sorted([*FOUR, *FOUR, ("36415", 1.5)])
    assert "MapInArrow" not in rows._jdf.queryExecution().toString()
    assert rates(flows.search_files(files, [A], single_pass=True)) == rates(rows)
    assert rates(flows.search_files(files, spark.createDataFrame([(A,)], "npi long"))) == rates(rows)
    raw = mrf.read_elements(written(twice))
    found = search.matching_items(search.read_provider_references(raw), search.read_in_network(raw), [A])
    assert sorted(r["billing_code"] for r in found.collect()) == ["36415", "36415", "99213", "J0129"]


def test_plan_to_results(written):
    files = [r["source_file"] for r in written(PLAN, PLAN, PLAN).orderBy("file_seq").collect()]
    tocs = written({"reporting_structure": [{"reporting_plans": [{"plan_id": p}], "in_network_files": [{"location": files[k]}, {"location": ""}]} for k, p in ((2, "X"), (1, "Y"))]}, {"reporting_structure": [{"reporting_plans": [{"plan_id": "x"}], "in_network_files": [{"location": files[0]}, {"location": files[2]}]}]})
    assert [r["source_file"] for r in flows.plan_files(tocs, "x").orderBy("file_seq").collect()] == [files[2], files[0]]
    rows = flows.search_plan(tocs, "X", [A]).collect()
    assert {r["source_file"] for r in rows} == {files[0], files[2]} and len(rows) == 8


def test_tokens_over_read_borders():
    body = [{"n": [1, {"b": "]"}]}, {"n": '"'}, 5, "a]\\", [["x", {}]], None, {"q": "\\\\\"{"}, {}, [], "", {"long": "[" * 50}]
    for space in (None, 1):
        text = json.dumps({"a": "x\\\"]}", "y": [1, "]", {"z": [2]}], "in_network": body, "z": [[]]}, indent=space).encode()
        for size in (1, 2, 3, 7, 50, 10**6):
            chunks = (text[k : k + size] for k in range(0, len(text), size))
            rows = [r for r in mrf.elements(chunks, ("in_network",)) if r[2] >= 0]
            assert [json.loads(r[3]) for r in rows] == body and [r[2] for r in rows] == list(range(len(body)))
    for bad in ('{"in_network": [{} {}]}', '{"in_network": [{},]}', '{"in_network": [{"a": 1}', '{"in_network": [{"a": "]}'):
        with pytest.raises(mrf.BrokenFile):
            list(mrf.elements(iter([bad.encode()]), ("in_network",)))
