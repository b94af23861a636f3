"""Column functions: parsing, labels and formatting. Built-in expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def npi_tokens(c: Column) -> Column:
    """The tokens of a comma list, trimmed; blank ones are skipped."""
    return F.filter(F.transform(F.split(_text(c), ","), lambda x: F.trim(x)), lambda x: x != "")


def npi_or_null(token: Column) -> Column:
    """A 10-digit provider number, or null."""
    n = token.try_cast("long")
    return F.when(token.rlike("^[+-]?[0-9]+$") & n.between(1_000_000_000, 9_999_999_999), n)


def parse_npis(c: Column, strict: bool = False) -> Column:
    """The provider numbers of a comma list. A token that is none gives null, or an error with ``strict``."""
    if not strict:
        return F.transform(npi_tokens(c), npi_or_null)
    bad = lambda x: F.raise_error(F.concat(F.lit("not a 10-digit NPI: "), x)).cast("long")
    return F.transform(npi_tokens(c), lambda x: F.coalesce(npi_or_null(x), bad(x)))


def file_name_from_url(url: Column) -> Column:
    """The last path segment before the query; a fragment stays."""
    path = F.substring_index(url, "?", 1)
    return F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -1)


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def url_query(url: Column) -> Column:
    return F.regexp_extract(F.substring_index(url, "#", 1), r"\?(.*)$", 1)


#: Host rules in the order in which they are tried, as (label, pattern of the host).
CDN_HOSTS = [
    ("AWS S3", r"\.amazonaws\.com$"),
    ("Google Cloud Storage", r"(^|\.)storage\.googleapis\.com$"),
    ("Azure Blob Storage", r"\.blob\.core\.windows\.net$"),
    ("Akamai", r"\.akamai"),
    ("Fastly", r"\.fastly\.net$"),
    ("Cloudflare", r"(\.cloudflare\.com|\.r2\.dev)$"),
]


def cdn_vendor(url: Column) -> Column:
    """Who serves the URL; the first rule that holds decides, blank if none does."""
    host, query = url_host(url), url_query(url)
    rules = F.when(host.endswith(".cloudfront.net") | query.contains("Key-Pair-Id="), "CloudFront")
    rules = reduce(lambda r, x: r.when(host.rlike(x[1]), x[0]), CDN_HOSTS, rules)
    return rules.when(host.endswith(".bcbs.com"), F.when(query.contains("Signature="), "CloudFront (BCBS)").otherwise("BCBS")).otherwise("")


def cdn_region(url: Column) -> Column:
    """The label after an exact ``s3`` label of a storage host, blank without one."""
    region = F.regexp_extract(url_host(url), r"(?:^|\.)s3\.(?!amazonaws(?:\.|$))([^.]+)", 1)
    return F.when(cdn_vendor(url) == "AWS S3", region).otherwise("")


def human_bytes(n: Column, max_unit: str = "TB") -> Column:
    """Bytes in units of 1024 with one decimal, ties to even."""
    units = ["KB", "MB", "GB", "TB"]
    units = units[: units.index(max_unit) + 1]
    out = F.format_string("%d B", n.cast("long"))
    for k, unit in enumerate(units, 1):
        out = F.when(n >= 1024**k, F.format_string(f"%.1f {unit}", F.bround(n / F.lit(float(1024**k)), 1))).otherwise(out)
    return out


def human_count(n: Column) -> Column:
    return F.format_number(n, 0)


def clean_field(c: Column) -> Column:
    """Trimmed; a double dash is blank."""
    t = F.trim(_text(c))
    return F.when(t == "--", "").otherwise(t)


def individual_name(basic: Column) -> Column:
    """LAST, FIRST MIDDLE."""
    last, first, middle = (clean_field(basic[f"{x}_name"]) for x in ("last", "first", "middle"))
    return F.concat(last, F.when(first != "", F.concat(F.lit(", "), first)).otherwise(""), F.when(middle != "", F.concat(F.lit(" "), middle)).otherwise(""))


def format_address(a: Column) -> Column:
    """City, ST 12345."""
    blank = lambda c: F.when(_text(c) != "", c)
    zip_code = _text(a["postal_code"])
    return F.concat(F.concat_ws(", ", blank(a["city"]), blank(a["state"])), F.when(zip_code != "", F.concat(F.lit(" "), F.left(zip_code, F.lit(5)))).otherwise(""))


def format_phone(c: Column) -> Column:
    """Ten characters without dashes as (xxx) xxx-xxxx, anything else unchanged."""
    p = F.trim(F.replace(_text(c), F.lit("-"), F.lit("")))
    return F.when(F.length(p) == 10, F.concat(F.lit("("), F.substring(p, 1, 3), F.lit(") "), F.substring(p, 4, 3), F.lit("-"), F.substring(p, 7, 4))).otherwise(_text(c))


def first_match(items: Column, test) -> Column:
    """The first item that passes, or null."""
    return F.get(F.filter(items, test), F.lit(0))


def provider_profile(record: dict[str, Column]) -> list[Column]:
    """The flat columns of a registry record, given by its nested columns."""
    basic, kind = record["basic"], record["enumeration_type"]
    person = F.coalesce(kind == "NPI-1", F.lit(False))
    primary = first_match(record["taxonomies"], lambda t: F.coalesce(t["primary"], F.lit(False)))
    # A primary entry without a description gives way to the first entry, as a record without one does.
    taxonomy = F.when(_text(primary["desc"]) != "", primary).otherwise(F.coalesce(F.get(record["taxonomies"], F.lit(0)), primary))
    place = first_match(record["addresses"], lambda a: F.coalesce(a["address_purpose"] == "LOCATION", F.lit(False)))
    address = F.when(format_address(place) != "", place).otherwise(F.coalesce(F.get(record["addresses"], F.lit(0)), place))
    return [
        F.coalesce(record["number"].try_cast("long"), F.lit(0).cast("long")).alias("npi"),
        F.when(person, "Individual").otherwise("Organization").alias("type"),
        F.when(person, individual_name(basic)).otherwise(_text(basic["organization_name"])).alias("name"),
        F.when(person, clean_field(basic["credential"])).otherwise("").alias("credential"),
        _text(taxonomy["desc"]).alias("primary_taxonomy"),
        _text(taxonomy["code"]).alias("taxonomy_code"),
        _text(format_address(address)).alias("practice_address"),
        format_phone(address["telephone_number"]).alias("practice_phone"),
        _text(basic["enumeration_date"]).alias("enumeration_date"),
        _text(basic["status"]).alias("status"),
        (_text(basic["status"]) != "A").alias("inactive"),
    ]


def split_provider_name(c: Column) -> Column:
    """First word and rest of a name; null for fewer than two words."""
    words = F.split(F.trim(_text(c)), r"\s+")
    return F.when(F.size(words) >= 2, F.struct(words[0].alias("first"), F.array_join(F.slice(words, F.lit(2), F.size(words)), " ").alias("last")))


def geo_label(city: Column, region: Column, country: Column, isp: Column) -> Column:
    blank = lambda c: F.when(_text(c) != "", c)
    place = F.concat_ws(", ", blank(city), blank(region), F.when(_text(country) != "United States", blank(country)))
    return F.when(place == "", "").otherwise(F.concat(place, F.when(_text(isp) != "", F.concat(F.lit(" ("), isp, F.lit(")"))).otherwise("")))


def is_gzip(content_type: Column, url: Column) -> Column:
    """By content type, or by the path without its query, so that signed URLs work."""
    return _text(content_type).contains("gzip") | F.substring_index(_text(url), "?", 1).endswith(".gz")


def short_label(name: Column, width: int = 40) -> Column:
    base = F.regexp_replace(name, r"\.json\.gz$", "")
    return F.rpad(F.when(F.length(base) > width, F.concat(F.lit("..."), F.right(base, F.lit(width - 3)))).otherwise(base), width, " ")
