"""Explicit schemas of the files and results; nothing is inferred."""

TIN = "STRUCT<type: STRING, value: STRING>"
GROUPS = f"ARRAY<STRUCT<npi: ARRAY<BIGINT>, tin: {TIN}>>"
PRICE = "STRUCT<negotiated_rate: DOUBLE, negotiated_type: STRING, billing_class: STRING, setting: STRING, expiration_date: STRING, service_code: ARRAY<STRING>, billing_code_modifier: ARRAY<STRING>>"
RATE = f"STRUCT<provider_references: ARRAY<DOUBLE>, provider_groups: {GROUPS}, negotiated_prices: ARRAY<{PRICE}>>"

#: An element of each section of a rate file, and of a table of contents.
REFERENCE = f"provider_group_id DOUBLE, provider_groups {GROUPS}"
ITEM = f"billing_code_type STRING, billing_code STRING, name STRING, description STRING, negotiation_arrangement STRING, negotiated_rates ARRAY<{RATE}>"
STRUCTURE = "reporting_plans ARRAY<STRUCT<plan_name: STRING, plan_id_type: STRING, plan_id: STRING>>, in_network_files ARRAY<STRUCT<description: STRING, location: STRING>>"

#: A raw element as the file source gives it.
RAW = "file_seq INT, source_file STRING, section STRING, section_ord INT, pos BIGINT, raw STRING"

RESULT = f"source_file STRING, npi BIGINT, tin {TIN}, billing_code_type STRING, billing_code STRING, billing_code_description STRING, negotiation_arrangement STRING, negotiated_rate DOUBLE, negotiated_type STRING, billing_class STRING, setting STRING, expiration_date STRING, service_code ARRAY<STRING>, billing_code_modifier ARRAY<STRING>"
RESULT_COLUMNS = "source_file npi tin billing_code_type billing_code billing_code_description negotiation_arrangement negotiated_rate negotiated_type billing_class setting expiration_date service_code billing_code_modifier".split()
PARAMS = "STRUCT<npis: ARRAY<BIGINT>, searched_files: BIGINT, matched_files: BIGINT, duration_seconds: DOUBLE>"

REGISTRY = (
    "number STRING, enumeration_type STRING, "
    "basic STRUCT<first_name: STRING, middle_name: STRING, last_name: STRING, credential: STRING, organization_name: STRING, enumeration_date: STRING, status: STRING>, "
    "addresses ARRAY<STRUCT<address_1: STRING, address_2: STRING, city: STRING, state: STRING, postal_code: STRING, address_purpose: STRING, telephone_number: STRING>>, "
    "taxonomies ARRAY<STRUCT<code: STRING, desc: STRING, primary: BOOLEAN, state: STRING, license: STRING>>"
)
