"""Plans, registry, functions, catalog and summaries."""

import json

import pytest
from pyspark.sql import functions as F

from ratelens.functions import text as T
from ratelens.operators import catalog, providers, summary, toc
from ratelens.plans.adapter import CDN_FORMS
from ratelens.schemas import REGISTRY
from ratelens.sources import files as sources
from ratelens.sources import mrf


def structures(spark, *bodies):
    return spark.createDataFrame([(0, "toc", "reporting_structure", 0, k, b if isinstance(b, str) else json.dumps(b)) for k, b in enumerate(bodies)], "file_seq int, source_file string, section string, section_ord int, pos long, raw string")


def structure(plan, *urls):
    return {"reporting_plans": [{"plan_id": plan}], "in_network_files": [{"location": u} for u in urls]}


def urls(raw, plan):
    return [r["url"] for r in toc.resolve_toc(raw, plan).orderBy("toc_seq", "structure_pos", "file_pos").collect()]


def test_plans(spark):
    raw = structures(spark, structure("AbC1", "u2", "u1", ""), structure("abc12", "u9"), structure("ABC1", "u1", "u3"), {"reporting_plans": [{"plan_id": 5}], "note": "abc1"}, '{"reporting_plans": [{"plan_id": "abc1"')
    assert urls(raw, "abc1") == ["u2", "u1", "u3"]
    assert toc.toc_stats(raw, "abc1").first().asDict() == {"structures": 5, "matched_structures": 2, "entity_name": ""}
    assert urls(raw, "abc") == []
    assert toc.toc_stats(structures(spark, structure("x")), "X").first().asDict() == {"structures": 1, "matched_structures": 1, "entity_name": ""}


def test_toc_file(spark, tmp_path):
    body = {"reporting_entity_name": "First", "other": {"reporting_structure": [1]}, "reporting_structure": [structure("p1", "u1")]}
    (tmp_path / "toc.json").write_text(json.dumps(body)[:-1] + ', "reporting_entity_name": "A \\"plan\\""}')
    files = spark.createDataFrame([(0, str(tmp_path / "toc.json"))], "file_seq int, source_file string")
    raw = mrf.read_elements(files, mrf.TOC_SECTIONS)
    assert urls(raw, "P1") == ["u1"]
    assert toc.toc_stats(raw, "p1").first().asDict() == {"structures": 1, "matched_structures": 1, "entity_name": 'A "plan"'}


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_cdn_rules(spark):
    for url, vendor, region in CDN_FORMS:
        assert one(spark, T.cdn_vendor(F.lit(url)), T.cdn_region(F.lit(url))) == (vendor, region), url


def test_formatting(spark):
    lit = F.lit
    sizes = {0: "0 B", 1023: "1023 B", 1024: "1.0 KB", 1280: "1.2 KB", 1408: "1.4 KB", 1 << 20: "1.0 MB", 5 << 30: "5.0 GB", 3 << 40: "3.0 TB"}
    assert one(spark, *[T.human_bytes(lit(n)) for n in sizes]) == tuple(sizes.values())
    assert one(spark, T.human_bytes(lit(3 << 40), "GB"), T.human_count(lit(1234567))) == ("3072.0 GB", "1,234,567")
    assert one(spark, T.file_name_from_url(lit("https://h/a/b.json.gz?x=/y")), T.file_name_from_url(lit("https://h/a/b#c"))) == ("b.json.gz", "b#c")
    assert one(spark, T.format_phone(lit("555-123-4567")), T.format_phone(lit("12345678901")), T.clean_field(lit(" -- ")), T.clean_field(lit(None).cast("string"))) == ("(555) 123-4567", "12345678901", "", "")
    assert one(spark, T.is_gzip(lit("application/gzip"), lit("x")), T.is_gzip(lit(None).cast("string"), lit("a.gz?s=1")), T.is_gzip(lit(""), lit("a?f=.gz"))) == (True, True, False)
    assert one(spark, T.geo_label(lit("X"), lit(""), lit("United States"), lit("I")), T.geo_label(lit(""), lit(""), lit("United States"), lit("I"))) == ("X (I)", "")
    assert one(spark, F.to_json(T.split_provider_name(lit(" Ann  van  Y ")))) == ('{"first":"Ann","last":"van Y"}',)
    assert one(spark, T.split_provider_name(lit("Ann"))) == (None,)
    label = one(spark, T.short_label(lit("a" * 50 + ".json.gz")))[0]
    assert label == "..." + "a" * 37 and one(spark, T.short_label(lit("x.json.gz")))[0] == "x" + " " * 39


def test_npi_lists(spark):
    assert one(spark, T.parse_npis(F.lit(" 1316924913 ,, 5 ,x"))) == ([1316924913, None, None],)
    with pytest.raises(Exception, match="10-digit"):
        one(spark, T.parse_npis(F.lit("1316924913,123456789"), strict=True))


def test_registry(spark):
    def record(number, kind="NPI-1", addresses=(), taxonomies=(), **basic):
        return json.dumps({"number": number, "enumeration_type": kind, "basic": basic, "addresses": list(addresses), "taxonomies": list(taxonomies)})

    mail = {"address_purpose": "MAILING", "city": "M", "state": "NY", "postal_code": "123456", "telephone_number": "1"}
    rows = [
        record("1", first_name="Ann", last_name="--", middle_name="Q", addresses=[mail, {"address_purpose": "LOCATION", "telephone_number": "2"}], taxonomies=[{"code": "a", "desc": "A"}, {"code": "b", "desc": "B", "primary": True}], status="A"),
        record("2", "NPI-2", organization_name="Org", addresses=[mail], taxonomies=[{"code": "a", "desc": "A"}], status="D"),
        record("3", last_name="Y", first_name="--", addresses=[{"address_purpose": "LOCATION", "postal_code": "90210"}]),
    ]
    table = spark.createDataFrame([(r,) for r in rows], "j string").select(F.from_json("j", REGISTRY).alias("x")).select("x.*")
    got = {r["npi"]: r for r in providers.profiles(table).collect()}
    assert (got[1]["name"], got[1]["practice_address"], got[1]["practice_phone"], got[1]["primary_taxonomy"]) == (", Ann Q", "M, NY 12345", "1", "B")
    assert (got[2]["name"], got[2]["type"], got[2]["primary_taxonomy"], got[2]["inactive"]) == ("Org", "Organization", "A", True)
    assert (got[3]["name"], got[3]["practice_address"], got[3]["primary_taxonomy"]) == ("Y", " 90210", "")
    asked = spark.createDataFrame([(0, 2), (1, 9), (2, 2)], "pos int, npi long")
    assert [r["name"] for r in providers.lookup_providers(asked, table).orderBy("pos").collect()] == ["Org", None, "Org"]
    assert [r["npi"] for r in providers.missing_providers(asked, table).collect()] == [9]
    assert providers.search_by_name(table, "ann", "--").count() == 1


def test_lists_catalog_and_merge(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("# head\n b \r\n\na\nb\n")
    listed = sources.read_url_list(spark, str(tmp_path / "urls.txt"))
    assert [r["url"] for r in listed.orderBy("pos").collect()] == ["b", "a", "b"]
    assert [r["source_file"] for r in sources.input_union(listed, listed).orderBy("file_seq").collect()] == ["b", "a", "b"] * 2
    far = spark.range(0, 200_000, 70).select(F.col("id").alias("pos"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"))
    numbered = sources.input_union(listed, far)
    assert numbered.agg(F.count("*"), F.count_distinct("file_seq"), F.max("file_seq")).first()[:] == (2861, 2861, 2860)
    assert numbered.filter("file_seq = 1003").first()["source_file"] == "u70000"
    assert sources.file_catalog(spark, str(tmp_path)).first()["length"] == 17
    vendors = lambda *v: catalog.label_distribution(spark.createDataFrame([(x,) for x in v], "vendor string"), "vendor").first()[0]
    assert vendors("b", "a", "", "a") == "a (2), b (1)" and vendors("a", "a") == "a" and vendors("") == ""
    sizes = spark.createDataFrame([(5,), (0,), (2,), (None,)], "length long")
    assert tuple(catalog.size_stats(sizes).first()) == (7, 3, 2, 5, 2, 4)
    assert tuple(catalog.size_stats(sizes.filter("false")).first()) == (0, None, None, None, 0, 0)
    runs = spark.createDataFrame([(0, [], 1, 0, 2.0), (1, [7], 2, 1, 1.0)], "run int, npis array<long>, searched_files long, matched_files long, duration_seconds double")
    assert tuple(summary.merge_outputs(runs).first()) == ([7], 3, 1, 2.0)
    shards = catalog.assign_shards(spark.range(5).withColumnRenamed("id", "file_seq"), 2)
    assert sorted(tuple(r) for r in shards.collect()) == [(0, 0), (1, 1), (2, 0), (3, 1), (4, 0)]
