"""Ingestion queries: files written from the test tables into the shared work
folder, then read back through the library's readers (SURVEY 2.1, 2.2)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from civitas.functions import (brl_to_decimal, date_dmy, id_to_text, safe_int)
from civitas.functions.dates import format_ntz
from civitas.operators.aggregates import count_rows
from civitas.operators.link import join_counts_zero_fill
from civitas.plans.registry import register
from civitas.session import materialize_table, plain_names, work_dir
from civitas.sources.csv_bulk import (bom_header_clean, conform_schema, scan_csv_headered,
                                      inspect_csv_files, schema_sniff_validate, text_schema,
                                      inject_period, null_tokens, path_value, read_seed,
                                      rename_if_present, route_files_by_kind, scan_csv_bulk,
                                      scan_csv_skip_banner)
from civitas.sources.json_records import (JSON_OPTS, parse_records, scan_json_drifting,
                                          scan_json_lines, singleton_to_list)
from civitas.sources.tables import table

# ---------------------------------------------------------------- JSON ----

RECORD_SCHEMA = ("codigo bigint, membro struct<id: bigint, partido: string, nome: string>, "
                 "periodos array<struct<inicio: timestamp_ntz, fim: timestamp_ntz>>")


def _raw_event_json(e):
    """The API-shaped payload of an event: nested member, two period
    sub-structs, and a child that is one object (even ids) or a list."""
    member = F.to_json(F.struct(F.col("user_id").alias("id"),
                                F.col("event_type").alias("partido")))
    none = F.lit(None).cast("timestamp_ntz")
    periods = F.to_json(F.array(F.struct(F.col("ts").alias("inicio"), none.alias("fim")),
                                F.struct(none.alias("inicio"),
                                         (F.col("ts") + F.expr("interval 1 hour")).alias("fim"))),
                        JSON_OPTS)
    child = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(
        F.concat(F.lit("["), F.col("props"), F.lit(","), F.col("props"), F.lit("]")))
    return F.concat(F.lit('{"codigo":'), F.col("event_id").cast("string"),
                    F.lit(',"membro":'), member, F.lit(',"periodos":'), periods,
                    F.lit(',"filhos":'), child, F.lit(',"props":'), F.col("props"), F.lit("}"))


@register("q_json_flatten", """
select event_id as codigo, cast(user_id as varchar) as membro_id, event_type as partido,
       cast(null as varchar) as nome, ts as inicio, ts + interval 1 hour as fim,
       case when event_id % 2 = 0 then 1 else 2 end as n_filhos,
       cast(json_extract(props, '$.k') as integer) * (case when event_id % 2 = 0 then 1 else 2 end) as soma_k,
       try_cast(json_extract_string(props, '$.k') as integer) as k
from events
""")
def q_json_flatten(spark, d):
    """scan_json_records / flatten_struct / flatten_two_period_span /
    singleton_to_list / id_to_text / safe_int / flat_record over JSON lines
    written from the events table."""
    path = work_dir(spark, "json-events")
    table(spark, d, "events").select(_raw_event_json(table(spark, d, "events")).alias("v")) \
        .write.mode("overwrite").text(path)
    raw = parse_records(scan_json_lines(spark, path), "json", RECORD_SCHEMA)
    filhos = singleton_to_list("json", "$.filhos", "struct<k: int>")
    return raw.select(
        F.col("r.codigo").alias("codigo"),
        id_to_text("r.membro.id").alias("membro_id"),
        F.col("r.membro.partido").alias("partido"),
        F.col("r.membro.nome").alias("nome"),
        F.col("r.periodos")[0]["inicio"].alias("inicio"),
        F.col("r.periodos")[1]["fim"].alias("fim"),
        F.size(filhos).alias("n_filhos"),
        F.aggregate(filhos, F.lit(0), lambda acc, x: acc + x["k"]).alias("soma_k"),
        safe_int(F.get_json_object("json", "$.props.k")).alias("k"))


TURN_SCHEMA = "conv bigint, turn bigint, linhas array<string>"


@register("q_json_explode", """
select conv_id, turn, role, i - 1 as line_no, string_split(text, chr(10))[i] as linha,
       len(string_split(text, chr(10))) as n_linhas
from conversations, range(1, len(string_split(text, chr(10))) + 1) t(i)
""")
def q_json_explode(spark, d):
    """split_parent_child (one parse -> a turn table and a line table),
    explode_children (parent key injected), inject_context (the role comes
    from the folder the record was written to)."""
    path = work_dir(spark, "json-conv")
    conv = table(spark, d, "conversations")
    (conv.select("role", F.to_json(F.struct(F.col("conv_id").alias("conv"), "turn",
                                            F.split("text", "\n", -1).alias("linhas"))).alias("v"))
         .write.mode("overwrite").partitionBy("role").text(path))
    parsed = parse_records(scan_json_lines(spark, path), "json", TURN_SCHEMA)
    parsed = parsed.select(F.col("r.conv").alias("conv_id"), F.col("r.turn").alias("turn"),
                           path_value("role").alias("role"), F.col("r.linhas").alias("linhas"))
    # two outputs from one parse, both written (parent / child tables)
    parent_path, child_path = path + "-turns", path + "-lines"
    parsed.select("conv_id", "turn", "role", F.size("linhas").alias("n_linhas")) \
        .write.mode("overwrite").parquet(parent_path)
    parsed.select("conv_id", "turn", F.posexplode("linhas").alias("line_no", "linha")) \
        .write.mode("overwrite").parquet(child_path)
    parent = spark.read.parquet(parent_path)
    child = spark.read.parquet(child_path)
    return (child.join(parent, ["conv_id", "turn"])
                 .select("conv_id", "turn", "role", F.col("line_no").cast("bigint").alias("line_no"),
                         "linha", F.col("n_linhas").cast("bigint").alias("n_linhas")))


# ----------------------------------------------------------------- CSV ----

CSV_TARGET = StructType([StructField(n, StringType(), True) for n in
                         ["ID_PEDIDO", "CLIENTE", "SITUACAO", "VALOR", "DATA"]])
BANNER = "Relatório de pedidos"
NEW_ID, OLD_ID = "ID_PEDIDO", "ORDERKEY"


def _write_bulk_csv(spark, d, root):
    """Fixture files derived from orders: even keys as UTF-8 per-state files
    with a BOM'd, padded header (two id spellings) plus a national file that
    repeats every row; odd keys as ISO-8859-1 files with a banner line."""
    o = table(spark, d, "orders")
    rows = o.select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_custkey").cast("string").alias("cliente"),
        F.when(F.col("o_orderstatus") == "P", F.lit("#NULO#"))
         .otherwise(F.col("o_orderstatus")).alias("situacao"),
        F.translate(F.format_number("o_totalprice", 2), ",.", ".,").alias("valor"),
        format_ntz("o_orderdate", "dd/MM/yyyy").alias("data"),
        F.col("o_orderpriority").alias("uf"), (F.col("o_orderkey") % 2).alias("par"))
    even = rows.where(F.col("par") == 0)
    first = F.coalesce(F.col("uf").isin("1-URGENT", "2-HIGH"), F.lit(False))
    for id_name, chosen in ((NEW_ID, first), (OLD_ID, ~first)):  # every priority lands
        part = even.where(chosen)
        names = ["﻿" + id_name, ' "CLIENTE" ', "SITUACAO", "VALOR", "DATA "]
        (part.select(F.col("id").alias(names[0]), F.col("cliente").alias(names[1]),
                     F.col("situacao").alias(names[2]), F.col("valor").alias(names[3]),
                     F.col("data").alias(names[4]), "uf")
             .write.mode("append").option("sep", ";").option("header", "true").option("escape", '"')
             .partitionBy("uf").csv(f"{root}/kind=estado"))
    (even.select(F.col("id").alias(NEW_ID), F.col("cliente").alias("CLIENTE"),
                 F.col("situacao").alias("SITUACAO"), F.col("valor").alias("VALOR"),
                 F.col("data").alias("DATA"), F.lit("BR_BRASIL").alias("uf"))
         .write.mode("append").option("sep", ";").option("header", "true").option("escape", '"')
         .partitionBy("uf").csv(f"{root}/kind=estado"))
    odd = rows.where(F.col("par") == 1)
    cols = ["id", "cliente", "situacao", "valor", "data"]
    banner = odd.select("uf").distinct().select(
        F.lit(BANNER + " — emitido pelo órgão").alias("id"),
        *[F.lit(None).cast("string").alias(c) for c in cols[1:]], "uf", F.lit(0).alias("ord"))
    header = odd.select("uf").distinct().select(
        F.lit(OLD_ID).alias("id"), F.lit("CLIENTE").alias("cliente"),
        F.lit("SITUACAO").alias("situacao"), F.lit("VALOR").alias("valor"),
        F.lit("DATA").alias("data"), "uf", F.lit(1).alias("ord"))
    body = odd.select(*cols, "uf", F.lit(2).alias("ord"))
    (banner.unionByName(header).unionByName(body)
           .repartition("uf").sortWithinPartitions("uf", "ord")
           .drop("ord").write.mode("append").option("sep", ";").option("header", "false")
           .option("encoding", "ISO-8859-1").partitionBy("uf").csv(f"{root}/kind=banner"))


def _read_estado_headered(spark, root):
    """One glob over every per-state file; the national aggregate is skipped
    by its path and each file's own header names its columns."""
    df = scan_csv_headered(
        spark, f"{root}/kind=estado/*",
        {"ID_PEDIDO": [NEW_ID, OLD_ID], "CLIENTE": ["CLIENTE"], "SITUACAO": ["SITUACAO"],
         "VALOR": ["VALOR"], "DATA": ["DATA"]},
        exclude_pattern=r"_BRASIL")
    return df.withColumn("UF", path_value("uf", F.col("__file"))).drop("__file")


def _read_estado_by_header(spark, root):
    """The same files through Spark's header option, one read per header
    spelling: bom_header_clean + rename_if_present + conform_schema."""
    parts = []
    for prios in (["1-URGENT", "2-HIGH"], ["3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]):
        paths = [f"{root}/kind=estado/uf={p}" for p in prios]
        df = bom_header_clean(scan_csv_bulk(spark, paths, None, ";", "UTF-8", header=True)
                              .select("*", path_value("uf").alias("__UF")))
        parts.append(rename_if_present(df, {"ID_PEDIDO": [NEW_ID, OLD_ID], "CLIENTE": "CLIENTE",
                                            "SITUACAO": "SITUACAO", "VALOR": "VALOR",
                                            "DATA": "DATA", "UF": "__UF"}))
    out = parts[0].unionByName(parts[1], allowMissingColumns=True)
    return conform_schema(out, StructType(CSV_TARGET.fields + [StructField("UF", StringType())]))


_CSV_ORACLE = """
select o_orderkey, o_custkey, nullif(o_orderstatus, 'P') as o_orderstatus,
       cast(cast(o_totalprice as decimal(18,2)) as double) as o_totalprice,
       cast(o_orderdate as date) as o_orderdate, o_orderpriority,
       year(o_orderdate) as ano,
       case when o_orderkey % 2 = 0 then 'estado' else 'banner' end as kind
from orders
"""


@register("q_csv_roundtrip", _CSV_ORACLE)
def q_csv_roundtrip(spark, d, estado_reader: str = "headered"):
    """scan_csv_bulk, scan_csv_skip_banner, scan_csv_multi_part (national
    file excluded), route_files_by_kind, bom_header_clean, rename_if_present
    (two id spellings), conform_schema, inject_period, null tokens,
    schema_sniff_validate (bounded check of each file kind before loading).
    ``estado_reader``: "headered" (one glob, per-file headers) or "header_option"
    (Spark's header option, one read per header spelling)."""
    root = work_dir(spark, "csv-orders")
    _write_bulk_csv(spark, d, root)
    for kind, enc in (("estado", "UTF-8"), ("banner", "ISO-8859-1")):
        check = schema_sniff_validate(spark, f"{root}/kind={kind}/*", ";", enc)
        if not check["ok"]:
            raise ValueError(f"{kind} files failed the input check: {check}")
    readers = {"headered": _read_estado_headered, "header_option": _read_estado_by_header}

    def read_estado():
        return readers[estado_reader](spark, root)

    def read_banner():
        df = scan_csv_skip_banner(spark, f"{root}/kind=banner/*", list(CSV_TARGET.fieldNames()),
                                  BANNER, ";", "ISO-8859-1", header_values=[NEW_ID, OLD_ID])
        return df.withColumn("UF", path_value("uf"))

    both = route_files_by_kind({"estado": read_estado, "banner": read_banner})
    both = null_tokens(both, ["SITUACAO"])
    typed = both.select(
        F.col("ID_PEDIDO").try_cast("bigint").alias("o_orderkey"),
        F.col("CLIENTE").try_cast("bigint").alias("o_custkey"),
        F.col("SITUACAO").alias("o_orderstatus"),
        brl_to_decimal("VALOR", 18, 2).cast("double").alias("o_totalprice"),
        date_dmy("DATA").alias("o_orderdate"),
        F.col("UF").alias("o_orderpriority"), "kind")
    return inject_period(typed, "ano", from_col="o_orderdate").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
        "o_orderpriority", "ano", "kind")


@register("q_csv_header_option", _CSV_ORACLE)
def q_csv_header_option(spark, d):
    """The same files through bom_header_clean, rename_if_present and
    conform_schema."""
    return q_csv_roundtrip(spark, d, estado_reader="header_option")


REGION_SEED = StructType([StructField("r_regionkey", IntegerType()),
                          StructField("r_name", StringType())])


@register("q_party_counts", """
with cnt as (select s_nationkey, count(*) as n_fornecedores from supplier group by 1)
select r.r_name as regiao, n.n_name as nacao, coalesce(cnt.n_fornecedores, 0) as n_fornecedores
from nation n left join region r on n.n_regionkey = r.r_regionkey
left join cnt on n.n_nationkey = cnt.s_nationkey
""")
def q_party_counts(spark, d):
    """scan_csv_seed (region written as a CSV seed, read with its schema),
    join_counts_zero_fill (nations without suppliers count 0),
    agg_distribution_by_type / agg_group_ordinal (explicit group columns)."""
    seed = work_dir(spark, "seed-region")
    table(spark, d, "region").write.mode("overwrite").option("header", "true").csv(seed)
    region = read_seed(spark, seed, REGION_SEED)
    n = table(spark, d, "nation")
    counts = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")) \
        .agg(count_rows().alias("n_fornecedores"))
    nat = n.join(region, n.n_regionkey == region.r_regionkey, "left")
    out = join_counts_zero_fill(nat, counts, "n_nationkey", ["n_fornecedores"])
    return out.select(F.col("r_name").alias("regiao"), F.col("n_name").alias("nacao"),
                      "n_fornecedores")


@register("q_csv_quarantine", """
with r as (select r_name, r_regionkey, count(*) as n from customer join nation on c_nationkey = n_nationkey
           join region on n_regionkey = r_regionkey group by 1, 2)
select r_name as regiao, n + 1 as linhas,
       case r_regionkey when 1 then 'separator' when 2 then 'encoding' when 3 then 'ragged' end as motivo,
       case when r_regionkey in (1, 2, 3) then 0 else n end as carregadas
from r
""")
def q_csv_quarantine(spark, d):
    """schema_sniff_validate per file: one CSV file per region, of which one has
    another separator, one holds bytes that are no text and one lines of odd
    width; each is told with its reason and only the others are loaded."""
    root = f"{work_dir(spark, 'csv-quarantine')}/files"
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    sep = F.when(F.col("r_regionkey") == 1, F.lit(",")).otherwise(F.lit(";"))
    name = F.when(F.col("r_regionkey") == 2, F.concat(F.lit("\x02"), F.col("c_name"))).otherwise(F.col("c_name"))
    tail = F.when(F.col("r_regionkey") == 3, F.lit(";x")).otherwise(F.lit(""))
    lines = rows.select(F.col("r_name").alias("regiao"), F.lit(1).alias("ord"), F.concat(
        F.col("c_custkey").cast("string"), sep, name, sep, F.col("c_acctbal").cast("string"), tail).alias("value"))
    heads = rows.select(F.col("r_name").alias("regiao"), F.lit(0).alias("ord"), F.concat(
        F.lit("CHAVE"), sep, F.lit("NOME"), sep, F.lit("SALDO")).alias("value")).distinct()
    lines.unionByName(heads).repartition("regiao").sortWithinPartitions("regiao", "ord") \
        .select("regiao", "value").write.partitionBy("regiao").text(root)
    report = materialize_table(inspect_csv_files(spark, root, required=["CHAVE", "SALDO"]), "csv-report")
    good = plain_names(spark, [f.file for f in report.where("ok").select("file").collect()])
    out = report.select(path_value("regiao", F.col("file")).alias("regiao"),
                        F.col("lines").alias("linhas"), F.col("reason").alias("motivo"))
    if not good:
        return out.withColumn("carregadas", F.lit(0).cast("long"))
    loaded = scan_csv_bulk(spark, good, text_schema(["chave", "nome", "saldo"])) \
        .groupBy(path_value("regiao").alias("r")).agg(F.count("chave").alias("k"))
    return out.join(loaded, F.col("regiao") == F.col("r"), "left").select(
        "regiao", "linhas", "motivo", F.coalesce("k", F.lit(0)).alias("carregadas"))


@register("q_json_drift", """
select case when event_id % 6 in (3, 4, 5) then null else event_id end as event_id,
       case event_id % 6 when 0 then value when 1 then value end as valor,
       case when event_id % 6 = 2 then 'valor' else '' end as mudou,
       case event_id % 6 when 3 then 'broken' when 4 then 'shape' when 5 then 'missing' end as motivo,
       count(*) as n
from events where value is not null group by all
""")
def q_json_drift(spark, d):
    """scan_json_records / flatten_struct on drifting records: the amount is a
    number, a text or an object, some lines are cut off, some are lists, some
    lack the key.  Every line lands in a defined place and the counts add up."""
    path = f"{work_dir(spark, 'json-drift')}/lines"
    e = table(spark, d, "events").where(F.col("value").isNotNull())
    rec = lambda *cols: F.to_json(F.struct(*cols))
    key, k = F.col("event_id").alias("id"), F.col("event_id") % 6
    whole = rec(key, F.col("value").alias("valor"))
    e.select(F.when(k == 0, whole).when(k == 1, rec(key, F.col("value").cast("string").alias("valor")))
             .when(k == 2, rec(key, F.struct(F.col("value").alias("total")).alias("valor")))
             .when(k == 3, F.left(whole, F.length(whole) - 1)).when(k == 4, F.concat(F.lit("["), whole, F.lit("]")))
             .otherwise(rec(F.col("value").alias("valor"))).alias("value")).write.text(path)
    rows = scan_json_drifting(spark, path, {"event_id": ("$.id", "bigint"), "valor": ("$.valor", "double")},
                              required=["event_id"])
    kept = F.col("rejected").isNull()
    return rows.groupBy(F.when(kept, F.col("event_id")).alias("event_id"),
                        F.when(kept, F.col("valor")).alias("valor"),
                        F.when(kept, F.array_join("drifted", ",")).otherwise("").alias("mudou"),
                        F.col("rejected").alias("motivo")).agg(F.count(F.lit(1)).alias("n"))
