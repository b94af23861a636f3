"""All queries of the library by name: each runs an operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.functions import text as T
from ratelens.operators import catalog, providers, search, summary, toc
from ratelens.plans import adapter as A
from ratelens.plans import flows
from ratelens.plans.oracles import PLAN, SQL, TARGETS  # noqa: F401
from ratelens.schemas import ITEM, REFERENCE
from ratelens.sources import files as sources
from ratelens.sources import bucketed, landing, mrf, sinks

NPIS = [1_000_000_000 + k for k in TARGETS]
ONE = NPIS[:1]


def flat(results: DataFrame) -> DataFrame:
    """Results in scalar columns."""
    joined = lambda c: F.coalesce(F.array_join(c, ","), F.lit("<null>")).alias(c)
    out: list[Column] = []
    for c in results.columns:
        if c == "tin":
            out += [F.col("tin.type").alias("tin_type"), F.col("tin.value").alias("tin_value")]
        elif c != "file_seq":
            out.append(joined(c) if c in ("service_code", "billing_code_modifier") else F.col(c))
    return results.select(*out)


def _parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return A.references(spark, sf), A.items(spark, sf)


def _broken(raw: DataFrame) -> DataFrame:
    """References by their number modulo seven: 3 has provider numbers as text, 5 is cut off."""
    k, text = F.when(F.col("section") == "provider_references", F.col("pos") % 7), F.col("raw")
    return raw.withColumn("raw", F.when(k == 3, F.regexp_replace(text, r'"npi":\[(\d+)\]', r'"npi":["$1"]')).when(k == 5, F.left(text, F.length(text) - 4)).otherwise(text))


def _typed(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    return search.read_provider_references(raw), search.read_in_network(raw)


def search_reference(spark, sf):
    return flat(search.search_by_reference(*_parts(spark, sf), NPIS))


def search_inline(spark, sf):
    return flat(search.search_inline(A.items(spark, sf), NPIS))


def search_full(spark, sf):
    return flat(search.search_rates(*_parts(spark, sf), NPIS))


def search_multi_npi(spark, sf):
    """Numbers as a table, with repeats and unknown ones."""
    asked = A.asked_npis(spark, sf).select(F.explode(F.array("npi", F.col("npi") + 5_000_000_000, "npi")).alias("npi"))
    return flat(search.search_rates(*_parts(spark, sf), asked))


def search_single_pass(spark, sf):
    raw = A.raw_elements(spark, sf)
    return flat(search.search_rates(*_typed(raw), ONE, search.single_pass_files(raw, ONE)))


def provider_index(spark, sf):
    index = search.provider_index(search.matched_providers(A.references(spark, sf), A.asked_npis(spark, sf)))
    return index.select("file_seq", "provider_group_id", F.size("providers").cast("long").alias("n_providers"), F.array_join("providers.npi", ",").alias("npis"))


def npi_matches(spark, sf):
    return summary.npi_matches(search.matched_providers(A.references(spark, sf), A.asked_npis(spark, sf)))


def matching_items(spark, sf):
    return search.matching_items(*_parts(spark, sf), NPIS).select("file_seq", "billing_code")


def raw_prefilter(spark, sf):
    return search.read_provider_references(search.prefilter_raw(A.raw_references(spark, sf), NPIS)).select("file_seq", "provider_group_id")


def malformed_drop(spark, sf):
    """Some references hold numbers as text, some are cut off; these elements go, the others stay."""
    return mrf.decode(_broken(A.raw_references(spark, sf)), REFERENCE, "file_seq", "pos").select("file_seq", "pos", "provider_group_id")


def description_fallback(spark, sf):
    return search.search_inline(A.items(spark, sf), A.asked_npis(spark, sf)).select("source_file", "billing_code", "billing_code_description").distinct()


def zero_defaults(spark, sf):
    return flat(search.search_inline(search.read_in_network(A.raw_elements(spark, sf, sparse=True)), NPIS))


def duplicate_file(spark, sf):
    """The first file listed twice."""
    listed = F.explode(F.when(F.col("file_seq") == 0, F.array(F.lit(0), F.lit(3))).otherwise(F.array("file_seq")))
    again = [x.withColumn("file_seq", listed) for x in _parts(spark, sf)]
    return search.search_rates(*again, NPIS).groupBy("source_file").agg(F.count("*").alias("rates"), F.count_distinct("file_seq").alias("searches"))


def search_summary(spark, sf):
    found = summary.search_summary(search.search_rates(*_parts(spark, sf), NPIS), A.files(spark), [*NPIS, NPIS[0]])
    return found.select(F.array_join("npis", ",").alias("npis"), "searched_files", "matched_files", "rates")


def file_counters(spark, sf):
    return summary.file_counters(_broken(A.raw_elements(spark, sf)))


def toc_resolve(spark, sf):
    return toc.resolve_toc(A.structures(spark, sf), PLAN.lower()).select("url", "structure_pos", F.col("file_pos").cast("long").alias("file_pos"))


def toc_stats(spark, sf):
    return toc.toc_stats(A.structures(spark, sf), PLAN)


def search_plan(spark, sf):
    urls = toc.resolve_toc(A.structures(spark, sf, of_rates=True), "customer#000000101").select(F.col("url").alias("source_file"))
    return flat(search.search_rates(*_parts(spark, sf), NPIS, A.files(spark).join(urls, "source_file")))


def url_list(spark, sf):
    """Lists with blank lines, comments and spaces around URLs."""
    path = sinks.work_path(spark, "urls")
    lines = F.explode(F.array(F.lit("# list"), F.lit("  "), F.concat(F.lit(" "), "url", F.lit("\t"))))
    A.table(spark, sf, "pages").select(lines.alias("value")).write.text(path)
    return sources.read_url_list(spark, path).groupBy("url").agg(F.count("*").alias("n"))


def input_union(spark, sf):
    pages = A.table(spark, sf, "pages").select(F.col("page_id").alias("pos"), "url")
    return sources.input_union(pages.filter("pos % 2 = 0"), pages).select(F.col("file_seq").cast("long").alias("file_seq"), "source_file")


def file_name(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", T.file_name_from_url(F.col("url")).alias("file_name"))


def cdn_vendor(spark, sf):
    url = F.col("url")
    return A.cdn_urls(spark, sf).select("page_id", T.cdn_vendor(url).alias("vendor"), T.cdn_region(url).alias("region"))


def cdn_distribution(spark, sf):
    return catalog.label_distribution(A.cdn_urls(spark, sf).select(T.cdn_vendor(F.col("url")).alias("vendor")), "vendor")


def size_stats(spark, sf):
    return catalog.size_stats(A.table(spark, sf, "documents").select(F.when(F.col("doc_id") % 10 == 0, 0).otherwise(F.col("n_chars")).alias("length")))


def human_bytes(spark, sf):
    n = F.col("n_chars") * F.pow(F.lit(1024), F.col("doc_id") % 4).cast("long")
    return A.table(spark, sf, "documents").select("doc_id", T.human_bytes(n).alias("size"), T.human_bytes(n, "GB").alias("size_gb"))


def human_count(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", T.human_count(F.col("n_chars") * 1001).alias("count_text"))


def parse_npis(spark, sf):
    k = F.col("c_custkey")
    listed = F.concat(F.lit(" "), A.npi(k).cast("string"), F.lit(" , ,"), k.cast("string"), F.lit(",12x,"), (A.npi(k) * 10).cast("string"))
    parsed = T.parse_npis(listed)
    valid = F.filter(parsed, lambda x: x.isNotNull())
    return A.table(spark, sf, "customer").select("c_custkey", F.size(parsed).cast("long").alias("tokens"), F.size(valid).cast("long").alias("valid"), F.get(valid, F.lit(0)).alias("first_npi"))


def lookup_providers(spark, sf):
    found = providers.lookup_providers(A.asked_npis(spark, sf), A.registry(spark, sf))
    return found.select("pos", "npi", *[F.coalesce(c, F.lit("<none>")).alias(c) for c in ("type", "name", "credential", "primary_taxonomy", "practice_address", "practice_phone", "status")], F.coalesce("inactive", F.lit(False)).alias("inactive"))


def missing_providers(spark, sf):
    return providers.missing_providers(A.asked_npis(spark, sf), A.registry(spark, sf))


def search_by_name(spark, sf):
    return providers.search_by_name(A.registry(spark, sf), "bob", " nation_7", "ca").select("npi", "name", "practice_address")


def format_fields(spark, sf):
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    phone = F.when(k % 2 == 0, F.concat(F.lit("555-"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("-1234"))).otherwise(F.lit("1-800"))
    name = T.split_provider_name(F.concat(F.lit("  "), seg, F.lit("   van "), F.col("c_name"), F.lit(" ")))
    country = F.when(k % 3 == 0, "United States").otherwise("Chile")
    return A.table(spark, sf, "customer").select(
        "c_custkey", T.clean_field(F.when(k % 4 == 0, " -- ").otherwise(F.concat(F.lit(" "), seg))).alias("cleaned"), T.format_phone(phone).alias("phone"), name["first"].alias("first_word"), name["last"].alias("rest"),
        T.geo_label(seg, F.lit(""), country, F.when(k % 5 == 0, "Net")).alias("place"), T.is_gzip(F.lit(None).cast("string"), F.when(k % 2 == 0, "x/a.json.gz?sig=1").otherwise("x/a.json")).alias("gzipped"),
        T.short_label(F.concat("c_name", F.when(k % 2 == 0, F.repeat(F.lit("-long"), 8)).otherwise(F.lit("")), F.lit(".json.gz"))).alias("label"),
    )


def assign_shards(spark, sf):
    pages = A.table(spark, sf, "pages").select(F.col("page_id").alias("file_seq"), F.col("url").alias("source_file"))
    return catalog.assign_shards(pages, 7).groupBy("shard").agg(F.count("*").alias("files"), F.min("file_seq").alias("first"))


def merge_outputs(spark, sf):
    """Each file searched by itself, then merged."""
    refs, items = _parts(spark, sf)
    found = search.search_rates(refs, items, NPIS).groupBy("file_seq").agg(F.count("*").alias("rates"))
    listed = F.array(*[F.lit(n).cast("long") for n in NPIS])
    runs = A.files(spark).join(found, "file_seq", "left").select(
        F.col("file_seq").alias("run"), F.when(F.col("file_seq") > 0, listed).otherwise(F.array().cast("array<bigint>")).alias("npis"), F.lit(1).cast("long").alias("searched_files"),
        F.when(F.col("rates") > 0, 1).otherwise(0).cast("long").alias("matched_files"), (F.col("file_seq") * 1.5).cast("double").alias("duration_seconds"),
    )
    return summary.merge_outputs(runs).withColumn("npis", F.array_join("npis", ","))


def split_roundtrip(spark, sf):
    path = sinks.work_path(spark, "sections")
    sinks.split_sections(A.raw_elements(spark, sf), path)
    return flat(search.search_rates(*_typed(sources.read_sections(spark, path)), NPIS))


def mrf_source_roundtrip(spark, sf):
    """Gzipped files written, then searched: each is read once."""
    return flat(flows.search_files(A.write_mrf_files(spark, sf), NPIS)).drop("source_file")


def plan_to_results(spark, sf):
    """Tables of contents over the written files, then the search of one plan's files."""
    return flat(flows.search_plan(A.write_tocs(spark, A.write_mrf_files(spark, sf)), "odd", NPIS)).drop("source_file")


def lines_roundtrip(spark, sf):
    """Elements as plain lines, read back by file and section, and searched."""
    path = sinks.work_path(spark, "lines")
    sinks.write_lines(A.raw_elements(spark, sf), path)
    return flat(search.search_rates(*_typed(sources.read_line_folders(spark, path)), NPIS))


def lines_of_a_file(spark, sf):
    """The references and rates of the first file, from its line files alone."""
    path = sinks.work_path(spark, "lines")
    sinks.write_lines(A.raw_elements(spark, sf), path)
    refs, items = (sources.read_lines(spark, [f"{path}/lines/file_seq=0/section={s}"], s, source_file="rates_A.json.gz") for s in mrf.SECTIONS)
    return flat(search.search_rates(search.read_provider_references(refs), search.read_in_network(items), NPIS))


def output_roundtrip(spark, sf):
    """Results with their parameters, written and read."""
    path = sinks.work_path(spark, "output")
    found = sinks.kept(search.search_rates(*_parts(spark, sf), NPIS))
    sinks.write_output(found, summary.search_summary(found, A.files(spark), NPIS), path)
    params, results = sinks.read_output(spark, path)
    given = params.select(F.array_join("npis", ",").alias("npis"), "searched_files", "matched_files")
    return flat(results).crossJoin(F.broadcast(given))  # one row


def land_roundtrip(spark, sf):
    path = sinks.work_path(spark, "landed")
    sinks.land(A.raw_elements(spark, sf), path)
    return flat(sinks.search_landed(spark, path, NPIS))


def results_roundtrip(spark, sf):
    path = sinks.work_path(spark, "results")
    sinks.write_results(search.search_inline(search.read_in_network(A.raw_elements(spark, sf, sparse=True)), NPIS), path)
    return flat(sinks.read_results(spark, path))


def validate_files(spark, sf):
    return catalog.validate_files(A.write_mrf_files(spark, sf)).select(F.col("file_seq").cast("long").alias("file_seq"), "ok", "elements")


def validate_damaged(spark, sf):
    """Written files of which some are cut off, go on after their object, or are not as long as they should be."""
    found = catalog.validate_files(A.write_damaged_files(spark, sf))
    kind = F.when(F.col("reason").contains("cut off"), "cut off").when(F.col("reason").contains("text after"), "text after").when(F.col("reason").startswith("read "), "length").otherwise(F.col("reason"))
    return found.select(F.col("file_seq").cast("long").alias("file_seq"), "ok", kind.alias("kind"))


def audit_files(spark, sf):
    """Sections of the files that are whole, and one row for each of the others."""
    found = catalog.audit_files(A.write_damaged_files(spark, sf))
    whole = F.col("reason") == ""
    return found.select(F.col("file_seq").cast("long").alias("file_seq"), F.coalesce("section", F.lit("<none>")).alias("section"), F.when(whole, F.col("elements")).alias("elements"), "malformed")


def mrf_blocks_roundtrip(spark, sf):
    """Written files, inflated into blocks of 64 KB and cut on all cores."""
    return flat(flows.search_files(A.write_mrf_files(spark, sf), NPIS, large=0, block=1 << 16)).drop("source_file")


def search_many_npis(spark, sf):
    """All numbers of the registry, looked up inside the scan."""
    return flat(flows.search_files(A.write_mrf_files(spark, sf), A.asked_npis(spark, sf))).drop("source_file")


def land_versions(spark, sf):
    """Half of the files landed, then all: the second landing reads the other half only."""
    path, files = sinks.work_path(spark, "versions"), A.write_mrf_files(spark, sf)
    landing.land_files(files.filter("file_seq % 2 = 0"), path)
    landing.land_files(files, path)
    return flat(landing.search_files(spark, path, NPIS)).drop("source_file")


def search_bucketed(spark, sf):
    """Landed rates in buckets, searched for a table of numbers."""
    path = sinks.work_path(spark, "landed")
    name = "rates_" + path[-32:]
    sinks.land(A.raw_elements(spark, sf), path)
    bucketed.bucket_landed(spark, path, name, buckets=16)
    return flat(bucketed.search_bucketed(spark, path, name, A.asked_npis(spark, sf)))


def plans_files(spark, sf):
    """The files of all plans: every customer's and every nation's."""
    plans = A.table(spark, sf, "customer").select(F.col("c_name").alias("plan_id")).union(A.table(spark, sf, "nation").select("n_name"))
    return toc.resolve_plans(toc.plan_index(A.structures(spark, sf)), plans).select("plan_id", "url", "structure_pos", F.col("file_pos").cast("long").alias("file_pos"))


def plans_to_results(spark, sf):
    """The search of several plans' files, each file read once."""
    plans = spark.createDataFrame([("Odd",), ("EVEN",), ("none",)], "plan_id string")
    return flat(flows.search_plans(A.write_tocs(spark, A.write_mrf_files(spark, sf)), plans, NPIS)).drop("source_file")


def file_catalog(spark, sf):
    return A.write_mrf_files(spark, sf).select(F.col("file_seq").cast("long").alias("file_seq"), catalog.known_size(F.col("length")).alias("known"))


def registry_roundtrip(spark, sf):
    path = sinks.work_path(spark, "registry")
    A.registry(spark, sf).write.json(path)
    return providers.profiles(sources.read_registry(spark, path)).select("npi", "type", "name", "status")


def multiline_source(spark, sf):
    """Small clean files through the built-in JSON reader, whole objects at a time."""
    schema = f"provider_references ARRAY<STRUCT<{REFERENCE}>>, in_network ARRAY<STRUCT<{ITEM}>>"
    whole = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(A.write_mrf(spark, sf)).drop("seq").select("*", F.regexp_extract("_metadata.file_path", "seq=([0-9]+)", 1).cast("int").alias("file_seq"), F.col("_metadata.file_path").alias("source_file"))
    refs = whole.select("file_seq", "source_file", F.explode("provider_references").alias("x")).select("file_seq", "source_file", "x.*")
    items = whole.select("file_seq", "source_file", F.posexplode("in_network").alias("pos", "x")).select("file_seq", "source_file", "pos", "x.*")
    return flat(search.search_rates(refs, items, NPIS)).drop("source_file")


_ALL = (
    search_reference, search_inline, search_full, search_multi_npi, search_single_pass, provider_index, npi_matches, matching_items, raw_prefilter, malformed_drop, description_fallback, zero_defaults,
    duplicate_file, search_summary, file_counters, toc_resolve, toc_stats, search_plan, url_list, input_union, file_name, cdn_vendor, cdn_distribution, size_stats, human_bytes, human_count, parse_npis,
    lookup_providers, missing_providers, search_by_name, format_fields, assign_shards, merge_outputs, split_roundtrip, mrf_source_roundtrip, land_roundtrip, results_roundtrip, validate_files, file_catalog,
    registry_roundtrip, multiline_source, plan_to_results, lines_roundtrip, lines_of_a_file, output_roundtrip,
    validate_damaged, audit_files, mrf_blocks_roundtrip, search_many_npis, land_versions, search_bucketed, plans_files, plans_to_results,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
