"""Search of negotiated rates by provider number.

Group ids belong to their file, so every join is on (file_seq, provider_group_id). Nothing is deduplicated:
a provider listed twice, a group listed twice or a file listed twice multiplies the result. No join is forced
to broadcast; the optimiser does so below its size limit, and adaptive execution splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratelens.schemas import GROUPS, ITEM, REFERENCE, RESULT_COLUMNS
from ratelens.sources.mrf import decode

Targets = Iterable[int] | DataFrame
#: Up to so many numbers are a list in the plan; more, or a table, are joined.
LISTED = 50
#: Up to so many numbers are looked for in an item's text before it is decoded.
SOUGHT = 8
#: Hash classes of group ids.
CLASSES = 1 << 16


def read_provider_references(raw: DataFrame) -> DataFrame:
    """Typed references of raw elements."""
    return decode(raw.filter("section = 'provider_references'"), REFERENCE, "file_seq", "source_file", "pos")


def read_in_network(raw: DataFrame, partitions: int | None = None) -> DataFrame:
    """Typed items of raw elements; ``partitions`` spreads the elements of large files before decoding."""
    raw = raw.filter("section = 'in_network'")
    return decode(raw.repartition(partitions) if partitions else raw, ITEM, "file_seq", "source_file", "pos")


def prefilter_raw(raw: DataFrame, npis: Iterable[int]) -> DataFrame:
    """Reference elements whose text holds a target number, and all other elements; the search gives the same.

    Above ``LISTED`` numbers everything passes: the test would cost more than decoding."""
    wanted = sorted({str(n) for n in npis})
    if len(wanted) > LISTED:
        return raw
    return raw.filter((F.col("section") != "provider_references") | F.col("raw").rlike("|".join(wanted) or "(?!)"))


def holding(raw: DataFrame, npis: Iterable[int]) -> DataFrame:
    """Elements whose text holds a target number, as each that lists a target does; for more numbers than ``SOUGHT``
    all elements, as the test would cost more than decoding."""
    wanted = sorted({str(n) for n in npis})
    if len(wanted) > SOUGHT:
        return raw
    return raw.filter(reduce(Column.__or__, [F.contains("raw", F.lit(n)) for n in wanted], F.lit(False)))


def only_targets(rows: DataFrame, npis: Targets) -> DataFrame:
    """Rows whose npi is a target; targets count once however often they are given."""
    if isinstance(npis, DataFrame):
        return rows.join(npis.select("npi").distinct(), "npi", "left_semi")
    listed = sorted({int(n) for n in npis})
    if len(listed) <= LISTED:
        return rows.filter(F.col("npi").isin(listed))
    return rows.join(rows.sparkSession.createDataFrame([(n,) for n in listed], "npi long"), "npi", "left_semi")


def _few(npis: Targets) -> bool:
    return not isinstance(npis, DataFrame) and len({int(n) for n in npis}) <= LISTED


def matched_providers(refs: DataFrame, npis: Targets) -> DataFrame:
    """file_seq, provider_group_id, npi, tin of every listing of a target in a group."""
    groups = refs.filter(F.col("provider_group_id").isNotNull()).select("file_seq", "provider_group_id", F.explode("provider_groups").alias("g"))
    return only_targets(groups.select("file_seq", "provider_group_id", F.explode("g.npi").alias("npi"), F.col("g.tin").alias("tin")), npis)


def provider_index(providers: DataFrame) -> DataFrame:
    """The matches of each group as a list."""
    return providers.groupBy("file_seq", "provider_group_id").agg(F.collect_list(F.struct("npi", "tin")).alias("providers"))


def rates(items: DataFrame) -> DataFrame:
    """A row for each rate of each item, with what is told of the item."""
    described = F.coalesce(F.nullif("name", F.lit("")), F.col("description"), F.lit(""))
    code = [F.coalesce(c, F.lit("")).alias(c) for c in ("billing_code_type", "billing_code", "negotiation_arrangement")]
    return items.select("file_seq", "source_file", "pos", *code, described.alias("billing_code_description"), F.posexplode("negotiated_rates").alias("rate_pos", "rate"))


def by_reference(rated: DataFrame, providers: DataFrame, few: bool = False) -> DataFrame:
    """Rates joined to matches through their group ids. With ``few`` wanted numbers, rates go first that name no group
    whose hash class has a match: most of them, so that they are not shuffled for the join."""
    asked = rated.select("*", F.explode("rate.provider_references").alias("provider_group_id"))
    if few:
        # At most CLASSES small rows, whatever the input.
        matched = F.broadcast(providers.select(_class().alias("group_class")).distinct())
        asked = asked.withColumn("group_class", _class()).join(matched, "group_class", "left_semi").select(*asked.columns)
    return asked.join(providers, ["file_seq", "provider_group_id"]).drop("provider_group_id")


def _class() -> Column:
    """The hash class of a group id in its file; ids that the join takes as equal are in one."""
    return F.pmod(F.xxhash64("file_seq", F.col("provider_group_id") + 0.0), F.lit(CLASSES)).cast("int")


def by_inline_group(rated: DataFrame, npis: Targets) -> DataFrame:
    """Rates joined to the targets in the groups that they list themselves. Listed targets are picked inside the
    arrays, so that other listings never become rows."""
    listed = None if isinstance(npis, DataFrame) else sorted({int(n) for n in npis})
    few = listed is not None and len(listed) <= LISTED
    wanted = (lambda n: n.isin(listed)) if few else (lambda n: n.isNotNull())
    match = lambda g: F.transform(F.filter(F.coalesce(g["npi"], F.array().cast("array<bigint>")), wanted), lambda n: F.struct(n.alias("npi"), g["tin"].alias("tin")))
    found = F.flatten(F.transform(F.coalesce("rate.provider_groups", F.array().cast(GROUPS)), match))
    rows = rated.select(*rated.columns, F.explode(found).alias("m")).select(*rated.columns, "m.npi", "m.tin")
    return rows if few else only_targets(rows, npis)


def project_results(hits: DataFrame) -> DataFrame:
    """A row for each match and price: missing scalars are blank or zero, missing arrays stay null."""
    priced = hits.select("*", F.explode("rate.negotiated_prices").alias("price"))
    blank = lambda c: F.coalesce(c, F.lit(""))

    def value(name: str) -> Column:
        if name == "tin":
            return F.struct(blank(F.col("tin.type")).alias("type"), blank(F.col("tin.value")).alias("value"))
        if name == "negotiated_rate":
            return F.coalesce("price.negotiated_rate", F.lit(0.0))
        if name in ("negotiated_type", "billing_class", "setting", "expiration_date"):
            return blank(F.col(f"price.{name}"))
        return F.col(f"price.{name}") if name in ("service_code", "billing_code_modifier") else F.col(name)

    return priced.select("file_seq", *(value(c).alias(c) for c in RESULT_COLUMNS))


def search_by_reference(refs: DataFrame, items: DataFrame, npis: Targets) -> DataFrame:
    return project_results(by_reference(rates(items), matched_providers(refs, npis), _few(npis)))


def search_inline(items: DataFrame, npis: Targets) -> DataFrame:
    return project_results(by_inline_group(rates(items), npis))


def single_pass_files(raw: DataFrame, npis: Targets) -> DataFrame:
    """file_seq of the files from which the one-pass mode returns rows.

    It skips the rates of a file with references of which none matches, and of a file whose rates come first
    unless a reference matched."""
    order = raw.groupBy("file_seq").agg(
        F.min(F.when(F.col("section") == "provider_references", F.col("section_ord"))).alias("refs_at"),
        F.min(F.when(F.col("section") == "in_network", F.col("section_ord"))).alias("rates_at"),
        F.count_if((F.col("section") == "provider_references") & (F.col("pos") >= 0)).alias("n_refs"),
    )
    matched = matched_providers(read_provider_references(raw), npis).groupBy("file_seq").agg(F.count("*").alias("n_matched"))
    first = F.coalesce(F.col("refs_at") < F.col("rates_at"), F.lit(False))
    return order.join(matched, "file_seq", "left").filter((F.coalesce("n_matched", F.lit(0)) > 0) | (first & (F.col("n_refs") == 0))).select("file_seq")


def search_matched(providers: DataFrame, items: DataFrame, npis: Targets, referenced: DataFrame | None = None) -> DataFrame:
    """All prices of the targets, given their matches in groups: an inner join for references, a filter for inline
    listings. ``referenced`` may be fewer items, those of files with a match, for the join."""
    joined = by_reference(rates(items if referenced is None else referenced), providers, _few(npis))
    return project_results(joined.unionByName(by_inline_group(rates(items), npis).select(*joined.columns)))


def search_rates(refs: DataFrame, items: DataFrame, npis: Targets, files: DataFrame | None = None, inline: DataFrame | None = None) -> DataFrame:
    """All negotiated prices of the targets, by reference and inline. ``files`` (file_seq) limits the search, for
    instance to ``single_pass_files``. ``inline`` may be fewer items, those whose text holds a target, for their own listings."""
    providers = matched_providers(refs, npis)
    inline = items if inline is None else inline
    if files is None:
        return search_matched(providers, inline, npis, items)
    # Items are never dealt by their file alone, as one can hold most of them: files limit what matched.
    only = files.select("file_seq").distinct()
    found = search_matched(providers.join(only, "file_seq", "left_semi"), inline, npis, items)
    return found.join(only, "file_seq", "left_semi").select(*found.columns)


def matching_items(refs: DataFrame, items: DataFrame, npis: list[int]) -> DataFrame:
    """Items with a rate that references a matched group or lists a target; nothing of a file is gathered in one row."""
    wanted = F.array(*[F.lit(int(n)).cast("long") for n in sorted(set(npis))])
    asked = items.select("file_seq", "pos", F.explode(F.array_distinct(F.flatten(F.transform("negotiated_rates", lambda r: F.coalesce(r["provider_references"], F.array().cast("array<double>")))))).alias("provider_group_id"))
    by_ref = asked.join(matched_providers(refs, npis).select("file_seq", "provider_group_id"), ["file_seq", "provider_group_id"], "left_semi").select(F.col("file_seq").alias("hit_file"), F.col("pos").alias("hit_pos")).distinct()
    inline = F.exists("negotiated_rates", lambda r: F.coalesce(F.exists(r["provider_groups"], lambda g: F.coalesce(F.arrays_overlap(g["npi"], wanted), F.lit(False))), F.lit(False)))
    found = items.join(by_ref, (items["file_seq"] == by_ref["hit_file"]) & (items["pos"] == by_ref["hit_pos"]), "left")
    return found.filter(F.col("hit_file").isNotNull() | inline).select(*items.columns)
