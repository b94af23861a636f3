"""Scans: ends of streams, blocks, the semi-join inside the scan, landing, pushdown and the committed sink."""

import gzip
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from ratelens.operators import catalog, search, toc
from ratelens.plans import adapter, flows, queries
from ratelens.sources import blocks, bucketed, committed, landing, matching, mrf, sinks
from tests.test_search import FOUR, PLAN, A, B, group, item, price, rate, rates, ref, written  # noqa: F401

GOOD = '{"in_network": [{"b": 2}]}'
ALL = (*mrf.SECTIONS, "reporting_entity_name")


@pytest.fixture
def stored(tmp_path, spark):
    def write(*bodies):
        rows = []
        for k, body in enumerate(bodies):
            path = tmp_path / f"{k}-{len(list(tmp_path.iterdir()))}.json.gz"
            path.write_bytes(body)
            rows.append((k, str(path), len(body)))
        return spark.createDataFrame(rows, "file_seq int, source_file string, length long")

    return write


def test_every_stream_is_read_to_its_end(stored):
    z = lambda s: gzip.compress(s.encode())
    bad = {
        "cut off": [z(GOOD)[:-4], z(GOOD)[:-8], z(GOOD[:-1]), z('{"in_network": [{},]}')],
        "damaged": [z(GOOD)[:-8] + bytes(8), z(GOOD) + b"junk"],
        "text after": [z(GOOD + " garbage {"), z(GOOD) + z("{}"), (GOOD + "]").encode(), z("{}}")],
        "not an array": [z('{"in_network": 5}')],
    }
    bodies = [(reason, body) for reason, found in bad.items() for body in found]
    files = stored(*[body for _, body in bodies], z(GOOD + " \n\t"), z(GOOD[:9]) + z(GOOD[9:]), z("{}"))
    checked = catalog.validate_files(files).orderBy("file_seq").collect()
    for (reason, body), r in zip(bodies, checked):
        assert not r["ok"] and reason in r["reason"] and r["bytes"] == len(body), r
        with pytest.raises(Exception, match=reason):
            mrf.read_elements(files.filter(F.col("file_seq") == r["file_seq"])).collect()
    assert [(r["ok"], r["reason"], r["elements"]) for r in checked[len(bodies) :]] == [(True, "", 1), (True, "", 1), (True, "", 0)]
    audited = catalog.audit_files(files).filter("reason = ''").groupBy().agg(F.sum("elements"), F.sum("malformed")).first()
    assert tuple(audited) == (2, 0)
    assert catalog.audit_files(files).filter("reason <> ''").count() == len(bodies)


def test_lengths_are_compared(stored):
    files = stored(gzip.compress(GOOD.encode())).withColumn("length", F.col("length") + 1)
    assert catalog.validate_files(files).first()["reason"].startswith("read 4")
    for read in (mrf.read_elements, blocks.read_split):
        with pytest.raises(Exception, match="bytes"):
            read(files).collect()
    assert catalog.validate_files(files.withColumn("length", F.lit(0))).first()["ok"]


ODD = [{"n": [1, {"b": "]"}]}, {"n": '"é'}, 5, "a]\\", [["x", {}]], None, {"q": '\\\\"{'}, {}, [], "", {"long": "[" * 50}]


@pytest.mark.parametrize("size", [5, 64, 1000])
def test_blocks_give_the_same_rows(stored, size):
    one = {"a": 'x\\"]}', "y": [1, "]", {"z": [2]}], "in_network": ODD, "z": [[]], "provider_references": [{"provider_group_id": 1}], "reporting_entity_name": "né"}
    two = json.dumps(one)[:-1] + ', "in_network":[ {"x":1} , 3 ], "provider_references": null, "in_network": [ ], "in_network":[7]}  \n'
    files = stored(*[gzip.compress(x.encode()) for x in (json.dumps(one), two, "{}", json.dumps(one, indent=1, ensure_ascii=False))])
    key = lambda r: str((r["file_seq"], r["source_file"], r["section"], r["section_ord"], r["pos"], r["raw"] and json.loads(r["raw"])))
    want = sorted(map(key, mrf.read_elements(files, ALL).collect()))
    assert sorted(map(key, blocks.read_split(files, ALL, size).collect())) == want


@pytest.mark.parametrize("text", [GOOD[:-1], GOOD + " x", GOOD + "{}", '{"in_network": [{} {}]}', '{"in_network": [{},]}', '{"in_network": [{"a": "]}', '{"in_network": 5}', "[]", ""])
def test_blocks_of_broken_files_fail(stored, text):
    with pytest.raises(Exception, match="BrokenFile"):
        blocks.read_split(stored(text.encode()), size=8).collect()


def test_small_files_share_tasks_and_a_file_is_one_row(stored):
    made = blocks.inflate(stored(*[gzip.compress(json.dumps({"in_network": [{"n": k}] * 9}).encode()) for k in range(60)]), size=16)
    assert len(made.inputFiles()) < 60 < made.count()
    # What blocks look up is a row for each file, so that it stays small beside them.
    states = blocks._states(made)
    assert states.count() == 60 and blocks._plan(made, states, ALL).count() == 60


def test_lexer_states_compose():
    rng = random.Random(3)
    for _ in range(300):
        text = json.dumps({"".join(rng.choices('a"\\[]{},', k=6)): ["".join(rng.choices('b\\"[', k=5))] * rng.randint(0, 3)}).encode()
        cut = rng.randint(1, len(text) - 1)
        first, second, whole = blocks.summary(text[:cut]), blocks.summary(text[cut:]), blocks.summary(text)
        assert [second[2 * first[0]], first[1] + second[2 * first[0] + 1]] == whole[:2] == [0, 0]


def test_the_scan_lets_through_what_can_match(written, spark):  # noqa: F811
    many = {"provider_references": [ref(k + 0.5, group([B + k])) for k in range(400)], "in_network": [item(str(k), [rate([price(1.0)], [k + 0.5])]) for k in range(400)]}
    swapped = {"in_network": PLAN["in_network"], "provider_references": PLAN["provider_references"]}
    thrice = json.dumps(swapped)[:-1] + ', "in_network": [' + json.dumps(item("99999", [rate([price(9.0)], [302.300000003])])) + "]}"
    forms = '{"provider_references": [{"provider_group_id": 3.0225e2, "provider_groups": [{"npi": [%d]}]}], "in_network": [{"billing_code": "e", "negotiated_rates": [{"provider_references" : [1, 302.25], "negotiated_prices": [{"negotiated_rate": 3}]}]}]}' % A
    files = written(PLAN, swapped, many, thrice, forms)
    raw = mrf.read_elements(files)
    for npis in ([A], [A, B], [1], [], [A, *range(2_000_000_000, 2_000_000_100)]):
        whole = search.search_rates(search.read_provider_references(raw), search.read_in_network(raw), npis)
        assert rates(flows.search_files(files, npis)) == rates(whole)
        assert rates(flows.search_files(files, spark.createDataFrame([(n,) for n in npis], "npi long"))) == rates(whole)
    size = lambda df: df.agg(F.sum(F.length("raw"))).first()[0] or 0
    big = matching.read_matching(files.filter("file_seq = 2"), [B + 7])
    assert big.filter("pos >= 0").count() == 2 and size(big) < 0.01 * size(raw.filter("file_seq = 2"))
    # A hundred thousand numbers: only references that hold one of them leave the scan.
    lots = [*range(3_000_000_000, 3_000_100_000), B + 3, B + 5]
    assert matching.read_matching(files.filter("file_seq = 2"), lots).filter("section = 'provider_references' AND pos >= 0").count() == 2
    assert matching.few_enough(spark.range(5).withColumnRenamed("id", "npi"), 4) is None


def test_items_without_a_target_are_not_decoded_for_their_own_listings(written):  # noqa: F811
    raw = mrf.read_elements(written(PLAN)).filter("section = 'in_network' AND pos >= 0")
    held = {r["raw"] for r in search.holding(raw, [A]).collect()}
    assert held == {r["raw"] for r in raw.collect() if str(A) in r["raw"]} and len(held) < raw.count()
    assert search.holding(raw, []).count() == 0 and search.holding(raw, range(search.SOUGHT + 1)).count() == raw.count()


def test_large_files_are_searched_in_blocks(written, spark):  # noqa: F811
    files = written(PLAN, PLAN).withColumn("length", F.when(F.col("file_seq") == 0, None).otherwise(0).cast("long"))
    assert rates(flows.search_files(files, [A], large=-1, block=100)) == sorted(FOUR * 2)
    assert rates(flows.search_files(files, [A], single_pass=True, large=-1, block=100)) == sorted(FOUR * 2)


def test_landing_again(written, spark, tmp_path):  # noqa: F811
    path, files = str(tmp_path / "store"), written(PLAN, PLAN)
    assert landing.land_files(files, path) == 1
    assert rates(landing.search_files(spark, path, [A])) == sorted(FOUR * 2)
    assert landing.land_files(files, path) == 2
    one, two = landing.manifest(spark, path, 1), landing.manifest(spark, path)
    assert one.drop("version").exceptAll(two.drop("version")).isEmpty() and two.first()["version"] == 2
    row = two.orderBy("file_seq").first()
    assert (row["refs_at"], row["rates_at"], row["n_references"], row["n_items"]) == (0, 1, 3, 4)
    # The second file changes, a third comes, and the first goes.
    changed = files.filter("file_seq = 1").first()["source_file"]
    with open(changed, "wb") as out:
        out.write(gzip.compress(json.dumps({"in_network": [item("1", [rate([price(1.0)], groups=[group([A])])])]}).encode()))
    third = written(PLAN).withColumn("file_seq", F.lit(2))
    landing.land_files(files.filter("file_seq = 1").unionByName(third), path)
    assert rates(landing.search_files(spark, path, [A])) == sorted([("1", 1.0), *FOUR])
    assert rates(landing.search_files(spark, path, [A], version=2)) == sorted(FOUR * 2)
    assert landing.manifest(spark, path).select("landing").distinct().count() == 1


def test_landed_search_is_pruned_in_both_branches(written, spark, tmp_path):  # noqa: F811
    path = str(tmp_path / "landed")
    sinks.land(mrf.read_elements(written(PLAN, {"in_network": [item("1", [rate([price(1.0)], groups=[group([B])]), {"negotiated_prices": []}])]})), path)
    found = sinks.search_landed(spark, path, [A])
    assert rates(found) == FOUR and rates(sinks.search_landed(spark, path, [B])) == [("1", 1.0), ("99214", 200.0)]
    plan = found._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    scans = [x for x in plan.splitlines() if "FileScan" in x and "negotiated_rates" in x]
    assert scans and all("dynamicpruning" in x for x in scans), scans
    assert any("PushedFilters" in x and f"npi,{A}" in x for x in plan.splitlines() if "FileScan" in x and "file_part" in x and "npi" in x)


def test_buckets_of_rates_are_not_dealt_again(written, spark, tmp_path):  # noqa: F811
    path = str(tmp_path / "landed")
    zero = {"provider_references": [ref(-0.0, group([A, A])), ref(7, group([B]))], "in_network": [item("0", [rate([price(4.0)], [0, 7], [group([A])])]), item("1", [rate([price(5.0)])])]}
    files = written(PLAN, zero)
    sinks.land(mrf.read_elements(files), path)
    bucketed.bucket_landed(spark, path, "some", buckets=4)
    numbers = spark.createDataFrame([(A,), (B,), (A,)], "npi long")
    want = search.search_rates(search.read_provider_references(mrf.read_elements(files)), search.read_in_network(mrf.read_elements(files)), numbers)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = bucketed.search_bucketed(spark, path, "some", numbers)
        lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
        assert rates(found) == rates(want) and len(rates(want)) == 5 + 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.sql("DROP TABLE some_members")
        spark.sql("DROP TABLE some_rates")
    at = next(k for k, x in enumerate(lines) if "FileScan" in x and "some_rates" in x)
    above, depth = [], len(lines[at]) - len(lines[at].lstrip(" :+-*"))
    for x in reversed(lines[:at]):
        own = len(x) - len(x.lstrip(" :+-*"))
        if own < depth:
            above.append(x)
            depth = own
    joins = next(k for k, x in enumerate(above) if "SortMergeJoin" in x)
    assert not any("Exchange" in x for x in above[:joins]), above


def test_filters_reach_the_source(written, spark):  # noqa: F811
    mrf.register(spark)
    files = written(PLAN, PLAN, PLAN)
    paths = [r["source_file"] for r in files.orderBy("file_seq").collect()]
    rows = spark.read.format("mrf_filtered").option("paths", json.dumps(paths)).load().filter("section = 'in_network' AND file_seq IN (0, 2) AND pos >= 0")
    assert rows.count() == 8 and rows.rdd.getNumPartitions() == 2 and {r["section_ord"] for r in rows.collect()} == {1}
    reader = mrf._FilteringReader(paths, mrf.SECTIONS)
    both = spark.read.format("mrf").option("paths", json.dumps(paths)).load()
    assert rates(search.search_rates(search.read_provider_references(both), search.read_in_network(both), [A])) == sorted(FOUR * 3)
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("section",), "provider_references"), GreaterThan(("pos",), 1), EqualTo(("file_seq",), 1)]))
    assert left == [GreaterThan(("pos",), 1)] and [p.path for p in reader.partitions()] == paths[1:2]
    assert {s for b in reader.read(reader.partitions()[0]) for s in b.column("section").to_pylist()} == {"provider_references"}


def test_results_are_committed_or_not_there(written, spark, tmp_path):  # noqa: F811
    committed.register(spark)
    path = str(tmp_path / "out")
    found = flows.search_files(written(PLAN), [A]).drop("file_seq")
    found.write.format("rate_results").option("search_params", json.dumps({"npis": [A]})).mode("append").save(path)
    params, rows = committed.read(spark, path)
    assert params == {"npis": [A]} and rates(rows) == FOUR and {r["source_file"] for r in rows.collect()} == {r["source_file"] for r in found.collect()}
    names = sorted(x.name for x in (tmp_path / "out").iterdir())
    bad = found.withColumn("npi", F.when(F.col("billing_code") == "J0129", F.raise_error(F.lit("no"))).otherwise(F.col("npi")).cast("long")).repartition(3)
    with pytest.raises(Exception):
        bad.write.format("rate_results").mode("append").save(path)
    assert sorted(x.name for x in (tmp_path / "out").iterdir()) == names and rates(committed.read(spark, path)[1]) == FOUR
    found.filter("false").write.format("rate_results").mode("append").save(path)
    assert committed.read(spark, path)[1].count() == 0


def test_many_plans(written):  # noqa: F811
    files = [r["source_file"] for r in written(PLAN, PLAN, PLAN).orderBy("file_seq").collect()]
    structure = lambda plans, *k: {"reporting_plans": [{"plan_id": p} for p in plans], "in_network_files": [{"location": files[x]} for x in k] + [{"location": ""}]}
    tocs = written({"reporting_structure": [structure(["X", "y", "x", None], 2, 0), structure(["Y"], 1, 2)]}, {"reporting_structure": [structure(["x"], 1)]})
    spark = tocs.sparkSession
    plans = spark.createDataFrame([("X",), ("Y",), ("Y",), ("none",)], "plan_id string")
    got = {}
    for r in flows.plans_files(tocs, plans).orderBy("plan_id", "file_seq").collect():
        got.setdefault(r["plan_id"], []).append(files.index(r["source_file"]))
    assert got == {"X": [2, 0, 1], "Y": [2, 0, 1]}
    for plan in ("X", "Y"):
        assert [files.index(r["source_file"]) for r in flows.plan_files(tocs, plan).orderBy("file_seq").collect()] == got[plan]
    rows = flows.search_plans(tocs, plans, [A])
    assert {tuple(r) for r in rows.groupBy("plan_id").count().collect()} == {("X", 12), ("Y", 12)}
    assert toc.plan_index(mrf.read_elements(tocs, ("reporting_structure",))).filter("plan_id = 'x'").count() == 3


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def test_small_files_share_tasks(written, spark):  # noqa: F811
    files = written(*[{"in_network": [item(str(k), [rate([price(1.0)], groups=[group([A])])])]} for k in range(40)])
    for listed in (files, files.withColumn("length", F.lit(100))):
        scan = mrf.dealt(listed)
        assert scan.count() == 40 and scan.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    assert len(rates(flows.search_files(files, [A]))) == 40
    large = files.filter("file_seq < 3").withColumn("length", F.lit(1 << 30))
    assert sorted(len(x) for x in mrf.dealt(large).rdd.glom().collect() if x) == [1, 1, 1]
    assert mrf.dealt(files.filter("false")).count() == 0


def test_files_limit_matches_not_items(written, spark):  # noqa: F811
    raw = mrf.read_elements(written(PLAN, PLAN))
    refs, items = search.read_provider_references(raw), search.read_in_network(raw)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = search.search_rates(refs, items, [A], spark.createDataFrame([(1,), (1,)], "file_seq int"))
        lines = _plan(found)
        assert rates(found) == FOUR and {r["file_seq"] for r in found.collect()} == {1}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    by_file = [lines[k + 1] for k, x in enumerate(lines[:-1]) if "Reused" not in x and re.search(r"Exchange hashpartitioning\(file_seq#\d+, \d+\)", x)]
    assert by_file and not any("negotiated_rates" in x for x in by_file), by_file


def test_a_small_file_lands_as_one_file(written, spark, tmp_path):  # noqa: F811
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sinks.land(mrf.read_elements(written(PLAN)), str(tmp_path / "landed"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(list((tmp_path / "landed" / "items" / "file_part=0").glob("*.parquet"))) == 1


def test_rows_are_dealt_once_and_decoded_once(spark, sf_dir):
    lines = _plan(adapter.items(spark, sf_dir))
    assert sum("Exchange hashpartitioning" in x for x in lines) == 1
    plan = search.read_in_network(adapter.raw_elements(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and plan.count("StructsToJsonEvaluator") == 1


def test_lines_are_written_gzipped(written, spark, tmp_path):  # noqa: F811
    raw = mrf.read_elements(written(PLAN))
    sinks.write_lines(raw, str(tmp_path / "lines"))
    sinks.split_sections(raw, str(tmp_path / "split"))
    for folder, ending in (("lines/lines", "txt"), ("split", "json")):
        names = [p.name for p in (tmp_path / folder).rglob("part-*")]
        assert names and all(n.endswith(f".{ending}.gz") for n in names), names


def test_results_and_their_summary_search_once(spark, sf_dir, monkeypatch):
    given, write = [], sinks.write_output
    monkeypatch.setattr(sinks, "write_output", lambda results, summary, path: (given.extend([results, summary]), write(results, summary, path)))
    got = queries.output_roundtrip(spark, sf_dir).drop("npis", "searched_files", "matched_files")
    assert len(given) == 2 and not any("l_returnflag" in x for df in given for x in _plan(df))
    assert sorted(map(str, got.collect())) == sorted(map(str, queries.search_full(spark, sf_dir).collect()))


def test_kept_results_are_the_same(written, spark):  # noqa: F811
    found = flows.search_files(written(PLAN, PLAN), [A])
    for rows in (found, found.filter("false"), found.withColumn("service_code", F.lit(None).cast("array<string>"))):
        again = sinks.kept(rows)
        assert again.columns == rows.columns and sorted(map(str, again.collect())) == sorted(map(str, rows.collect()))


def test_lines_are_dealt_once_where_nothing_is_broadcast(spark, sf_dir):
    want = {c.__name__: sorted(map(str, c(spark, sf_dir).collect())) for c in (queries.search_full, queries.duplicate_file)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        # Lines by supplier and by part, and both of these tables.
        assert sum("Exchange hashpartitioning" in x for x in _plan(adapter.items(spark, sf_dir))) == 4
        got = {c.__name__: sorted(map(str, c(spark, sf_dir).collect())) for c in (queries.search_full, queries.duplicate_file)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == want and want["duplicate_file"]


def test_a_file_listed_twice_is_built_once(spark, sf_dir):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lines = _plan(queries.duplicate_file(spark, sf_dir))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum("FileScan" in x and "l_returnflag" in x for x in lines) == 1


def test_rates_without_a_match_are_not_shuffled(written, spark):  # noqa: F811
    zero = {"provider_references": [ref(-0.0, group([A, A])), ref(7, group([B])), ref(8, group([B + 1]))], "in_network": [item("0", [rate([price(4.0)], [0, 7, 8, 9], [group([A])])]), item("1", [rate([price(5.0)], [-0.0]), rate([price(6.0)], [8])])]}
    raw = mrf.read_elements(written(PLAN, zero))
    refs, items = search.read_provider_references(raw), search.read_in_network(raw)
    for npis in ([A], [A, B], [1]):
        table = spark.createDataFrame([(n,) for n in npis], "npi long")
        assert rates(search.search_rates(refs, items, npis)) == rates(search.search_rates(refs, items, table))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lines = _plan(search.search_by_reference(refs, items, [A]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    dealt = next(k for k, x in enumerate(lines) if "Exchange hashpartitioning(file_seq" in x and "provider_group_id" in x)
    assert any("BroadcastHashJoin" in x and "LeftSemi" in x for x in lines[dealt : dealt + 4]), lines
