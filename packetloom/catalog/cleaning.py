"""Queries over cleaning, validation and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.catalog.bindings import (
    CLEAN_FLOWS_SQL,
    IDENTITY_SQL,
    RAW_FLOWS_SQL,
    SCORED_SQL,
    clean_sql,
    dirty_canonical,
    raw_flows,
    scored_flows,
    table,
    text_feature,
    text_flows,
)
from packetloom.catalog.registry import query, rounded
from packetloom.functions.labels import decode_label, encode_label, map_labels
from packetloom.functions.values import (
    coerce_double,
    coerce_long,
    is_valid_ipv4,
    sanitize,
    valid_threshold,
)
from packetloom.operators.alerts import attack_rows
from packetloom.operators.features import (
    clean_numeric,
    engineer_features,
    feature_array,
    feature_map,
    flows_from_json,
    identity_columns,
    sanitize_strings,
    strip_headers,
    to_flows,
)
from packetloom.operators.statistics import non_negative
from packetloom.operators.validation import validate_features, validate_requests
from packetloom.schemas import COUNTERS, FEATURE_HEADERS, FEATURES, LABELS, NON_NEGATIVE


def _list(items) -> str:
    return ", ".join(items)


def _rounded_sql(names) -> str:
    return _list(f"round({n}, 6) as {n}" for n in names)


@query(
    "b1_strip_headers",
    f"with {RAW_FLOWS_SQL} select flow_id, flow_duration as a, total_bwd_packets as b, "
    "avg_packet_size as c from flows",
)
def _(spark, d):
    raw = strip_headers(raw_flows(spark, d))
    return raw.select(
        "flow_id",
        F.col("`Flow Duration`").alias("a"),
        F.col("`Total Backward Packets`").alias("b"),
        F.col("`Average Packet Size`").alias("c"),
    )


@query(
    "b2_clean_numeric",
    f"with {CLEAN_FLOWS_SQL} select flow_id, {_rounded_sql(FEATURES)} from clean",
)
def _(spark, d):
    return rounded(clean_numeric(dirty_canonical(spark, d)))


@query(
    "b3_canonical_features",
    f"with {CLEAN_FLOWS_SQL} select flow_id, {_rounded_sql(FEATURES)} from clean",
)
def _(spark, d):
    return rounded(engineer_features(raw_flows(spark, d), keep=["flow_id"]))


@query(
    "b4_fixed_schema",
    f"with {CLEAN_FLOWS_SQL} select flow_id, "
    + _list(
        f"round({f}, 6) as {f}" if i % 2 == 0 else f"0::double as {f}"
        for i, f in enumerate(FEATURES)
    )
    + " from clean",
)
def _(spark, d):
    raw = strip_headers(raw_flows(spark, d))
    absent = [h for i, h in enumerate(FEATURE_HEADERS.values()) if i % 2]
    return rounded(engineer_features(raw.drop(*absent), keep=["flow_id"]))


@query(
    "b5_first_present",
    "select cast(event_id as string) as flow_id, "
    "case when event_id % 4 = 0 then concat('t', cast(event_id as string)) else 'parsed' end as timestamp, "
    "case when event_id % 5 <> 0 then "
    + IDENTITY_SQL.split("then ", 1)[1].split(" when", 1)[0]
    + " when event_id % 10 = 0 then '1.2.3.4' else '0.0.0.0' end as src_ip, "
    "case when event_id % 6 = 0 then 'x' else cast(event_id % 65536 as string) end as src_port, "
    "case when event_id % 3 = 0 then 'UDP' else 'TCP' end as protocol from events",
)
def _(spark, d):
    out = identity_columns(text_flows(spark, d), keep=["flow_id"])
    stamp = F.when(F.col("timestamp").startswith("t"), F.col("timestamp")).otherwise("parsed")
    return out.select("flow_id", stamp.alias("timestamp"), "src_ip", "src_port", "protocol")


_PARSED = [f"try_cast({text_feature(k)} as double)" for k in range(len(FEATURES))]


@query(
    "b6_coerce_double",
    "select event_id as flow_id, "
    + _list(f"round({clean_sql(_PARSED[k])}, 6) as v{k}" for k in (0, 3, 9))
    + f", case when isfinite({_PARSED[5]}) then round({_PARSED[5]}, 6) else -1::double end as v5"
    + " from events",
)
def _(spark, d):
    t = text_flows(spark, d)
    heads = list(FEATURE_HEADERS.values())
    out = t.select(
        F.col("flow_id").cast("bigint").alias("flow_id"),
        *[coerce_double(F.col(f"`{heads[k]}`")).alias(f"v{k}") for k in (0, 3, 9)],
        coerce_double(F.col(f"`{heads[5]}`"), -1.0).alias("v5"),
    )
    return rounded(out)


@query(
    "b7_coerce_long",
    "select event_id as flow_id, "
    + _list(f"cast(trunc({clean_sql(_PARSED[k])}) as bigint) as v{k}" for k in (1, 2, 26))
    + " from events",
)
def _(spark, d):
    t = text_flows(spark, d)
    heads = list(FEATURE_HEADERS.values())
    return t.select(
        F.col("flow_id").cast("bigint").alias("flow_id"),
        *[coerce_long(F.col(f"`{heads[k]}`")).alias(f"v{k}") for k in (1, 2, 26)],
    )


_FLOW_FIELDS = _list(
    f"cast(trunc({clean_sql(_PARSED[k])}) as bigint) as {f}"
    if f in COUNTERS
    else f"round({clean_sql(_PARSED[k])}, 6) as {f}"
    for k, f in enumerate(FEATURES)
)


@query(
    "b8_to_flows",
    f"select cast(event_id as string) as flow_id, {IDENTITY_SQL}, {_FLOW_FIELDS} from events",
)
def _(spark, d):
    return rounded(to_flows(text_flows(spark, d), keep=["flow_id"]).drop("timestamp"))


@query(
    "b9_feature_vector",
    f"with {CLEAN_FLOWS_SQL} select flow_id, cast(30 as int) as width, "
    "round(flow_duration, 6) as first, round(subflow_bwd_bytes, 6) as last, "
    f"round({' + '.join(f'{f} * {i + 1}' for i, f in enumerate(FEATURES))}, 4) as checksum from clean",
)
def _(spark, d):
    v = engineer_features(raw_flows(spark, d), keep=["flow_id"]).select(
        "flow_id", feature_array().alias("v")
    )
    weighted = F.aggregate(
        F.transform("v", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x
    )
    return v.select(
        "flow_id",
        F.size("v").alias("width"),
        F.round(F.col("v")[0], 6).alias("first"),
        F.round(F.col("v")[29], 6).alias("last"),
        F.round(weighted, 4).alias("checksum"),
    )


@query(
    "b10_feature_map",
    f"with {CLEAN_FLOWS_SQL} select flow_id, feature, round(value, 6) as value from "
    f"(unpivot (select flow_id, {_list(FEATURES)} from clean) on {_list(FEATURES)} "
    "into name feature value value)",
)
def _(spark, d):
    flows = engineer_features(raw_flows(spark, d), keep=["flow_id"])
    out = flows.select("flow_id", F.explode(feature_map()).alias("feature", "value"))
    return rounded(out)


@query(
    "b11_flow_from_json",
    f"select cast(event_id as string) as flow_id, {IDENTITY_SQL}, {_FLOW_FIELDS} from events",
)
def _(spark, d):
    flows = to_flows(text_flows(spark, d), keep=["flow_id"])
    body = F.to_json(F.struct(*[c for c in flows.columns if c != "flow_id"]))
    text = flows.select("flow_id", body.alias("body"))
    return rounded(flows_from_json(text, "body").drop("timestamp"))


def violations_sql(nonneg, whole) -> str:
    parts = []
    for f in FEATURES:
        case = f"when {f} is null then '{f}:null' when isnan({f}) then '{f}:nan' when isinf({f}) then '{f}:inf'"
        if f in nonneg:
            case += f" when {f} < 0 then '{f}:negative'"
        if f in whole:
            case += f" when {f} <> floor({f}) then '{f}:not_integer'"
        parts.append(f"case {case} end")
    return f"concat_ws(',', {', '.join(parts)})"


def joined(df):
    text = F.transform("violations", lambda v: F.concat_ws(":", v["feature"], v["reason"]))
    return df.select("flow_id", F.array_join(text, ",").alias("violations"))


@query(
    "b12_validate_flag",
    f"with {RAW_FLOWS_SQL} select flow_id, {violations_sql(NON_NEGATIVE, ())} as violations from flows",
)
def _(spark, d):
    return joined(validate_features(dirty_canonical(spark, d), "flag"))


@query(
    "b12_validate_quarantine",
    f"with {RAW_FLOWS_SQL}, v as (select flow_id, {violations_sql(NON_NEGATIVE, ())} as violations from flows) "
    "select * from v where violations <> ''",
)
def _(spark, d):
    return joined(validate_features(dirty_canonical(spark, d), "quarantine"))


@query(
    "b12_valid_rows",
    f"with {RAW_FLOWS_SQL}, v as (select *, {violations_sql(NON_NEGATIVE, ())} as violations from flows) "
    f"select flow_id, {_rounded_sql(FEATURES)} from v where violations = ''",
)
def _(spark, d):
    return rounded(validate_features(dirty_canonical(spark, d), "valid"))


@query(
    "b13_validate_requests",
    f"with {RAW_FLOWS_SQL} select flow_id, {violations_sql(FEATURES, COUNTERS)} as violations from flows",
)
def _(spark, d):
    return joined(validate_requests(dirty_canonical(spark, d), "flag"))


def _ipv4_sql(expr: str) -> str:
    return (
        f"coalesce(regexp_full_match({expr}, '([0-9]{{1,3}}[.]){{3}}[0-9]{{1,3}}') and "
        f"list_bool_and(list_transform(string_split({expr}, '.'), lambda p: "
        "coalesce(try_cast(p as int) <= 255, false))), false)"
    )


@query(
    "b14_valid_ipv4",
    f"with {SCORED_SQL} select flow_id, src_ip, {_ipv4_sql('src_ip')} as src_ok, "
    f"{_ipv4_sql('dst_ip')} as dst_ok from scored",
)
def _(spark, d):
    return scored_flows(spark, d).select(
        "flow_id",
        "src_ip",
        is_valid_ipv4(F.col("src_ip")).alias("src_ok"),
        is_valid_ipv4(F.col("dst_ip")).alias("dst_ok"),
    )


_QUAD = "[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+"


@query(
    "b14_valid_ipv4_in_documents",
    f"with q as (select doc_id, unnest(regexp_extract_all(text, '{_QUAD}')) as quad from documents) "
    f"select doc_id, quad, {_ipv4_sql('quad')} as ok from q",
)
def _(spark, d):
    quads = table(spark, d, "documents").select(
        "doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"({_QUAD})"))).alias("quad")
    )
    return quads.withColumn("ok", is_valid_ipv4(F.col("quad")))


@query(
    "b15_valid_threshold",
    "select event_id, coalesce(value / 100 between 0 and 1, false) as ok from events",
)
def _(spark, d):
    return table(spark, d, "events").select(
        "event_id", valid_threshold(F.col("value") / 100).alias("ok")
    )


@query(
    "b16_sanitize_documents",
    "select doc_id, substring(translate(text, '<>&', ''), 1, 1000) as text, lang, source, n_chars from documents",
)
def _(spark, d):
    return sanitize_strings(table(spark, d, "documents"), ["text"])


@query(
    "b16_sanitize_pages",
    "select page_id, substring(translate(url, '<>&', ''), 1, 1000) as url, "
    "substring(translate(html, '<>&', ''), 1, 1000) as html from pages",
)
def _(spark, d):
    return sanitize_strings(table(spark, d, "pages"))


@query(
    "b16_sanitize_conversations",
    "select conv_id, turn, substring(translate(text, '<>&', ''), 1, 1000) as text from conversations",
)
def _(spark, d):
    return table(spark, d, "conversations").select(
        "conv_id", "turn", sanitize(F.col("text")).alias("text")
    )


@query(
    "b17_attack_rows",
    f"with {SCORED_SQL} select flow_id, prediction from scored where prediction <> 'Normal'",
)
def _(spark, d):
    return attack_rows(scored_flows(spark, d)).select("flow_id", "prediction")


@query(
    "b18_non_negative_samples",
    f"with {SCORED_SQL} select flow_id, round(memory_mb, 6) as memory_mb from scored where memory_mb >= 0",
)
def _(spark, d):
    return rounded(non_negative(scored_flows(spark, d), "memory_mb").select("flow_id", "memory_mb"))


_LABEL_SQL = """case
  when trim(label_raw) = 'Normal' or lower(trim(label_raw)) = 'benign' then 'Normal'
  when lower(trim(label_raw)) like 'dos%' or lower(trim(label_raw)) in ('ddos', 'heartbleed') then 'DoS'
  when lower(trim(label_raw)) in ('portscan', 'port scan') then 'Port Scan'
  when lower(trim(label_raw)) like '%patator%' or lower(trim(label_raw)) like '%brute force%' then 'Brute Force'
  else 'Data Exfiltration' end"""
_LABEL_ID_SQL = "cast(case cat " + " ".join(
    f"when '{n}' then {i}" for i, n in enumerate(LABELS)
) + " else 0 end as int)"
_CAT_SQL = f"{RAW_FLOWS_SQL}, cats as (select flow_id, label_raw, {_LABEL_SQL} as cat from flows)"


@query("c1_map_labels", f"with {_CAT_SQL} select flow_id, label_raw, cat from cats")
def _(spark, d):
    return raw_flows(spark, d).select(
        "flow_id", F.col("Label").alias("label_raw"), map_labels(F.col("Label")).alias("cat")
    )


@query("c2_encode_labels", f"with {_CAT_SQL} select flow_id, {_LABEL_ID_SQL} as label_id from cats")
def _(spark, d):
    return raw_flows(spark, d).select(
        "flow_id", encode_label(map_labels(F.col("Label"))).alias("label_id")
    )


@query(
    "c3_decode_labels",
    "select event_id, case event_id % 8 "
    + " ".join(f"when {i} then '{n}'" for i, n in enumerate(LABELS))
    + " else cast(event_id % 8 as string) end as label, case when event_id % 8 > 4 then "
    "concat('class_', cast(event_id % 8 as string)) else '' end as unknown from events",
)
def _(spark, d):
    label_id = F.col("event_id") % 8
    return table(spark, d, "events").select(
        "event_id",
        decode_label(label_id).alias("label"),
        F.when(label_id > 4, decode_label(label_id, "class_")).otherwise("").alias("unknown"),
    )


@query(
    "d1_label_lookup",
    f"with {SCORED_SQL}, dim(label_id, label) as (values "
    + _list(f"({i}, '{n}')" for i, n in enumerate(LABELS))
    + ") select flow_id, y_true, label from scored left join dim on y_true = label_id",
)
def _(spark, d):
    # the vocabulary as a table: five rows by definition, so it is broadcast
    dim = spark.range(len(LABELS)).select(
        F.col("id").cast("int").alias("y_true"), decode_label(F.col("id")).alias("label")
    )
    flows = scored_flows(spark, d).select("flow_id", "y_true")
    return flows.join(F.broadcast(dim), "y_true", "left").select("flow_id", "y_true", "label")
