"""Rate-file shaped data from the star-schema tables, so that queries run the real operators at any scale.

file: l_returnflag. provider number: 1000000000 + s_suppkey. group id: s_suppkey + file + 0.5, so one id names
different suppliers in different files; the third file references even suppliers only. item: a part in a file.
Rates of line status F reference a group, those of O list their provider. price: a line item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratelens.sources import mrf, sinks
from ratelens.sources.files import file_catalog

#: Parts of one generated file, and customers of one plan structure: groups stay this small at any scale.
PARTS, CUSTOMERS = 500, 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def npi(key: Column) -> Column:
    return key.cast("long") + F.lit(1_000_000_000)


def file_of(flag: Column) -> Column:
    return F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2)


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, f"rates_{x}.json.gz") for k, x in enumerate("ANR")], "file_seq int, source_file string")


def group(key: Column, name: Column) -> Column:
    return F.struct(F.array(npi(key)).alias("npi"), F.struct(F.lit("ein").alias("type"), name.alias("value")).alias("tin"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_seq, source_file, pos, provider_group_id, provider_groups."""
    s = table(spark, sf_dir, "supplier").crossJoin(F.broadcast(files(spark)))  # three files
    s = s.filter((F.col("file_seq") < 2) | (F.col("s_suppkey") % 2 == 0))
    groups = F.array(group(F.col("s_suppkey"), F.col("s_name"))).alias("provider_groups")
    return s.select("file_seq", "source_file", F.col("s_suppkey").alias("pos"), (F.col("s_suppkey") + F.col("file_seq") + 0.5).alias("provider_group_id"), groups)


def price_rows(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    """file_seq, bucket, and what items need of a line item, its part and its supplier: nothing nested yet. Rows are
    dealt once: by part before parts are joined, which are dealt alike if they are not broadcast, or by file and bucket."""
    l, p, s = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    lines = l.join(s, l["l_suppkey"] == s["s_suppkey"]).select("l_partkey", "l_returnflag", "s_suppkey", "s_name", "l_linestatus", "l_extendedprice", "l_shipdate", "l_linenumber")
    if by == "p_partkey":
        lines = lines.repartition("l_partkey")
    rows = lines.join(p, lines["l_partkey"] == p["p_partkey"]).select(
        file_of(F.col("l_returnflag")).alias("file_seq"), F.floor(F.col("p_partkey") / PARTS).cast("int").alias("bucket"), "l_returnflag", "p_partkey", "p_name", "p_type", "p_size",
        "s_suppkey", "s_name", "l_linestatus", "l_extendedprice", "l_shipdate", "l_linenumber",
    )
    return rows if by == "p_partkey" else rows.repartition("file_seq", by)


def items(spark: SparkSession, sf_dir: str, sparse: bool = False, by: str = "p_partkey") -> DataFrame:
    """file_seq, source_file, pos, the columns of an item, and its bucket; a part's rates in a file are few at any
    scale. A rate for each supplier and line status, with its prices. ``sparse``: every third part lacks rate, setting
    and service code. Rows are dealt once, by part or by file and bucket, while they are flat; all grouping is done where they are then."""
    keys = ["file_seq", "bucket", "l_returnflag", "p_partkey", "p_name", "p_type", "p_size"]
    rows = price_rows(spark, sf_dir, by)
    line = F.struct("s_suppkey", "s_name", "l_linestatus", "l_extendedprice", "l_shipdate", "l_linenumber")
    by_part = rows.groupBy(*keys).agg(F.collect_list(line).alias("lines"))
    some = (lambda c: F.when(F.col("p_partkey") % 3 != 0, c)) if sparse else (lambda c: c)

    def price(x: Column) -> Column:
        return F.struct(
            some(x["l_extendedprice"]).alias("negotiated_rate"), F.lit("negotiated").alias("negotiated_type"), x["l_linestatus"].alias("billing_class"), some(F.lit("outpatient")).alias("setting"),
            F.date_format(x["l_shipdate"], "yyyy-MM-dd").alias("expiration_date"), some(F.array(x["l_linenumber"].cast("string"))).alias("service_code"), F.array().cast("array<string>").alias("billing_code_modifier"),
        )

    of = ("s_suppkey", "s_name", "l_linestatus")
    kinds = F.array_distinct(F.transform("lines", lambda x: F.struct(*[x[c].alias(c) for c in of])))

    def rate(k: Column) -> Column:
        inline = k["l_linestatus"] == "O"
        same = F.filter("lines", lambda x: x["s_suppkey"].eqNullSafe(k["s_suppkey"]) & x["s_name"].eqNullSafe(k["s_name"]) & x["l_linestatus"].eqNullSafe(k["l_linestatus"]))
        return F.struct(
            F.when(~inline, F.array(k["s_suppkey"] + F.col("file_seq") + 0.5)).alias("provider_references"), F.when(inline, F.array(group(k["s_suppkey"], k["s_name"]))).alias("provider_groups"),
            F.transform(same, price).alias("negotiated_prices"),
        )

    return by_part.select(
        "file_seq", F.concat(F.lit("rates_"), "l_returnflag", F.lit(".json.gz")).alias("source_file"), F.col("p_partkey").alias("pos"),
        F.lit("CPT").alias("billing_code_type"), F.col("p_partkey").cast("string").alias("billing_code"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("").alias("name"),
        F.col("p_type").alias("description"), F.lit("ffs").alias("negotiation_arrangement"), mrf.once(F.transform(kinds, rate)).alias("negotiated_rates"), "bucket",
        F.filter(kinds, lambda k: k["l_linestatus"] != "O").alias("referring"),
    )


def _raw(rows: DataFrame, section: str, order: int) -> DataFrame:
    body = [c for c in rows.columns if c not in ("file_seq", "source_file", "pos")]
    return rows.select("file_seq", "source_file", F.lit(section).alias("section"), F.lit(order).alias("section_ord"), F.col("pos").cast("long").alias("pos"), mrf.once(F.to_json(F.struct(*body))).alias("raw"))


def raw_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(references(spark, sf_dir), "provider_references", 0)


def raw_elements(spark: SparkSession, sf_dir: str, sparse: bool = False) -> DataFrame:
    return raw_references(spark, sf_dir).unionByName(_raw(items(spark, sf_dir, sparse), "in_network", 1))


def write_mrf(spark: SparkSession, sf_dir: str, damaged: bool = False) -> str:
    """The folder of gzipped rate files, each with the items of a range of parts and the references that they need.
    ``damaged``: of five files, number 1 goes on after its object and number 2 is cut off."""
    found = items(spark, sf_dir, by="bucket")
    body = F.struct("billing_code_type", "billing_code", "name", "description", "negotiation_arrangement", "negotiated_rates")
    # As ``references``: a group of every supplier in the first two files, of even ones in the third. As texts they are
    # told apart by their hashes.
    there = F.filter("referring", lambda k: (F.col("file_seq") < 2) | (k["s_suppkey"] % 2 == 0))
    refer = F.transform(there, lambda k: F.to_json(F.struct((k["s_suppkey"] + F.col("file_seq") + 0.5).alias("provider_group_id"), F.array(group(k["s_suppkey"], k["s_name"])).alias("provider_groups"))))
    listed = found.select("file_seq", "bucket", F.to_json(body).alias("item"), refer.alias("refer")).groupBy("file_seq", "bucket")
    rows = listed.agg(F.concat_ws(",", F.collect_list("item")).alias("items"), F.array_join(F.array_distinct(F.flatten(F.collect_list("refer"))), ",").alias("refs"))
    whole = F.concat(F.lit('{"reporting_entity_name": "a plan", "provider_references": ['), "refs", F.lit('], "other": {"x": [1, "]}"]}, "in_network": ['), "items", F.lit("]}"))
    path = sinks.work_path(spark, "mrf")
    rows = rows.select((F.col("bucket") * 3 + F.col("file_seq")).alias("seq"), whole.alias("value"))
    if damaged:
        text = F.col("value")
        rows = rows.withColumn("value", F.when(F.col("seq") % 5 == 1, F.concat(text, F.lit(" {"))).when(F.col("seq") % 5 == 2, F.left(text, F.length(text) - 3)).otherwise(text))
    rows.write.partitionBy("seq").option("compression", "gzip").text(path)
    return path


def write_damaged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog of written files, some of them damaged; of five, number 3 should be a byte longer than it is."""
    files = write_mrf_files(spark, sf_dir, damaged=True)
    return files.withColumn("length", F.when(F.col("file_seq") % 5 == 3, F.col("length") + 1).otherwise(F.col("length")))


def write_mrf_files(spark: SparkSession, sf_dir: str, damaged: bool = False) -> DataFrame:
    """The catalog of the written files."""
    return file_catalog(spark, write_mrf(spark, sf_dir, damaged)).select(F.regexp_extract("path", "seq=([0-9]+)", 1).cast("int").alias("file_seq"), F.col("path").alias("source_file"), "length")


def write_tocs(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Tables of contents, each over a hundred files: those of odd and of even number are a plan each."""
    plan = F.struct(F.lit("a plan").alias("plan_name"), F.lit("HIOS").alias("plan_id_type"), F.when(F.col("file_seq") % 2 == 1, "ODD").otherwise("EVEN").alias("plan_id"))
    body = F.struct(F.array(plan).alias("reporting_plans"), F.array(F.struct(F.lit("rates").alias("description"), F.col("source_file").alias("location"))).alias("in_network_files"))
    listed = files.groupBy(F.floor(F.col("file_seq") / 100).cast("int").alias("seq")).agg(F.concat_ws(",", F.collect_list(F.to_json(body))).alias("all"))
    path = sinks.work_path(spark, "tocs")
    listed.select("seq", F.concat(F.lit('{"reporting_entity_name": "a plan", "reporting_structure": ['), "all", F.lit("]}")).alias("value")).write.partitionBy("seq").text(path)
    return file_catalog(spark, path).select(F.regexp_extract("path", "seq=([0-9]+)", 1).cast("int").alias("file_seq"), F.col("path").alias("source_file"))


def structures(spark: SparkSession, sf_dir: str, of_rates: bool = False) -> DataFrame:
    """Raw plan structures: one for every hundred customers, whose names and nations are its plans. Its files are
    three pages and one that all share, or with ``of_rates`` a rate file."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    bucket = F.floor(F.col("c_custkey") / CUSTOMERS).alias("pos")
    plan = lambda name: F.struct(name.alias("plan_name"), F.lit("HIOS").alias("plan_id_type"), name.alias("plan_id"))
    plans = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(bucket, F.explode(F.array(plan(F.col("c_name")), plan(F.col("n_name")))).alias("plan")).groupBy("pos").agg(F.collect_set("plan").alias("reporting_plans"))
    file = lambda url: F.struct(F.lit("rates").alias("description"), url.alias("location"))
    if of_rates:
        name = F.element_at(F.array(*[F.lit(f"rates_{x}.json.gz") for x in "ANR"]), (F.pmod("pos", F.lit(3)) + 1).cast("int"))
        both = plans.withColumn("in_network_files", F.array(file(name)))
    else:
        pages = table(spark, sf_dir, "pages").select("page_id", "url")
        own = pages.select(F.floor(F.col("page_id") / 3).alias("pos"), F.struct("page_id", file(F.col("url")).alias("f")).alias("x"))
        shared = F.array(file(F.lit("https://files.example.com/shared.json.gz")), file(F.lit("")))
        listed = own.groupBy("pos").agg(F.array_sort(F.collect_list("x")).alias("x"))
        both = plans.join(listed, "pos", "left").withColumn("in_network_files", F.concat(shared, F.coalesce("x.f", F.array().cast("array<struct<description:string,location:string>>")))).drop("x")
    found = _raw(both.select(F.lit(0).alias("file_seq"), F.lit("toc.json").alias("source_file"), "pos", "reporting_plans", "in_network_files"), "reporting_structure", 0)
    names = n.filter("n_nationkey < 2").select(F.lit(0), F.lit("toc.json"), F.lit("reporting_entity_name"), F.lit(-1), F.col("n_nationkey").cast("long"), F.to_json(F.array("n_name")).substr(F.lit(2), F.length("n_name") + 2))
    return found.union(names)


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested registry records of all suppliers but every eleventh; every third is an organization."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    k = F.col("s_suppkey")
    first = F.element_at(F.array(*map(F.lit, ("Ann", "Bob", "Cleo", "Dan", "--"))), (k % 5 + 1).cast("int"))
    blank = F.lit("")
    basic = F.struct(
        first.alias("first_name"), F.when(k % 4 == 0, "Q").otherwise(" -- ").alias("middle_name"), F.col("n_name").alias("last_name"), F.when(k % 2 == 0, "MD").otherwise("--").alias("credential"),
        F.col("s_name").alias("organization_name"), F.lit("2010-01-01").alias("enumeration_date"), F.when(k % 6 == 0, "D").otherwise("A").alias("status"),
    )
    address = lambda city, state, code, purpose, phone: F.struct(blank.alias("address_1"), blank.alias("address_2"), city.alias("city"), state.alias("state"), code.alias("postal_code"), F.lit(purpose).alias("address_purpose"), phone.alias("telephone_number"))
    mail = address(F.lit("Mailtown"), F.lit("NY"), F.lit("123456789"), "MAILING", F.lit("555-000-1111"))
    home = address(F.when(k % 5 == 0, "").otherwise("Hometown"), F.when(k % 5 == 0, "").otherwise("CA"), F.when(k % 5 == 0, "").otherwise("90210"), "LOCATION", F.lit("12345678901"))
    taxonomy = lambda code, primary: F.struct(F.lit(code).alias("code"), F.concat(F.lit("Kind "), F.lit(code)).alias("desc"), primary.alias("primary"), blank.alias("state"), blank.alias("license"))
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).filter(k % 11 != 0).select(
        npi(k).cast("string").alias("number"), F.when(k % 3 == 0, "NPI-2").otherwise("NPI-1").alias("enumeration_type"), basic.alias("basic"),
        F.array(mail, home).alias("addresses"), F.array(taxonomy("207", F.lit(False)), taxonomy("208", k % 2 == 0)).alias("taxonomies"),
    )


def asked_npis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pos"), npi(F.col("s_suppkey")).alias("npi"))


#: URL forms with the label that each must get, by page_id modulo their number.
CDN_FORMS = [
    ("https://d1.cloudfront.net/a", "CloudFront", ""),
    ("https://mrf.example.com/a?Key-Pair-Id=K", "CloudFront", ""),
    ("https://s3.us-east-1.amazonaws.com/b/a", "AWS S3", "us-east-1"),
    ("https://bucket.s3.eu-west-2.amazonaws.com/a", "AWS S3", "eu-west-2"),
    ("https://bucket.s3.amazonaws.com/a", "AWS S3", ""),
    ("https://storage.googleapis.com/a", "Google Cloud Storage", ""),
    ("https://x.blob.core.windows.net/a", "Azure Blob Storage", ""),
    ("https://x.akamaized.net/a", "Akamai", ""),
    ("https://x.fastly.net/a", "Fastly", ""),
    ("https://pub.r2.dev/a", "Cloudflare", ""),
    ("https://mrf.bcbs.com/a?Signature=S", "CloudFront (BCBS)", ""),
    ("https://mrf.bcbs.com/a?Signature=S&Key-Pair-Id=K", "CloudFront", ""),
    ("https://MRF.bcbs.com:8443/a", "BCBS", ""),
    ("https://plain.example.com/a#Key-Pair-Id=K", "", ""),
]


def cdn_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = F.array(*[F.lit(url) for url, _, _ in CDN_FORMS])
    k = F.col("page_id")
    return table(spark, sf_dir, "pages").select("page_id", F.element_at(forms, (F.pmod(k, F.lit(len(CDN_FORMS))) + 1).cast("int")).alias("url"))
