"""VCF text from a variation table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.table import Variations


def header(v: Variations, version: str = "VCFv4.2") -> list[str]:
    meta = v.metadata or {}
    lines = [f"##fileformat={meta.get('fileformat', version)}"]
    lines += [f"##{k}={x}" for k, x in meta.get("OTHER", {}).items()]
    there = _names(v)
    for group in ("INFO", "FORMAT", "FILTER"):
        for name, about in meta.get(group, {}).items():
            if group == "FILTER" or name in there[group]:
                items = "".join(f',{k}="{x}"' if k == "Description" else f",{k}={x}" for k, x in about.items())
                lines.append(f"##{group}=<ID={name}{items}>")
    return [*lines, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *v.samples])]


def _names(v: Variations) -> dict[str, list[str]]:
    schema = v.df.schema
    info = schema["info"].dataType if "info" in schema.names else None
    calls = schema["calls"].dataType.elementType.names
    return {"INFO": info.names if isinstance(info, T.StructType) else [], "FORMAT": [c.upper() for c in calls]}


def _text(x: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.when(x.isNotNull(), F.array_join(F.transform(x, lambda y: F.coalesce(_text(y, kind.elementType), F.lit("."))), ","))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.regexp_replace(F.round(x, 4).cast("string"), r"\.0$", "")
    if isinstance(kind, T.BooleanType):
        return x.cast("int").cast("string")
    return x.cast("string")


def body(v: Variations) -> DataFrame:
    """row_idx, chrom, pos, value: a line per variant."""
    schema = v.df.schema
    or_dot = lambda x: F.coalesce(x, F.lit("."))
    have = set(schema.names)
    infos = []
    if "info" in have and isinstance(schema["info"].dataType, T.StructType):
        for f in schema["info"].dataType.fields:
            x = F.col("info")[f.name]
            infos.append(F.when(x, F.lit(f.name)) if isinstance(f.dataType, T.BooleanType) else F.when(x.isNotNull(), F.concat(F.lit(f"{f.name}="), _text(x, f.dataType))))
    info = F.array_join(F.array_compact(F.array(*infos)), ";") if infos else F.lit("")
    filters = F.lit(".")
    if "filters" in have:
        failed = F.array_join(F.map_keys(F.map_filter("filters", lambda k, x: x == 0)), ";")
        applied = F.size(F.map_filter("filters", lambda k, x: x.isNotNull())) > 0
        filters = F.when(F.col("filters").isNull() | ~applied, ".").when(failed == "", "PASS").otherwise(failed)
    call = schema["calls"].dataType.elementType
    fields = [f for f in call.fields if f.name != "gt"]

    def one(c: Column) -> Column:
        gt = F.array_join(F.transform(c["gt"], lambda a: F.coalesce(a.cast("string"), F.lit("."))), "/")
        return F.concat_ws(":", gt, *[or_dot(_text(c[f.name], f.dataType)) for f in fields])

    line = F.concat_ws(
        "\t", "chrom", F.col("pos").cast("string"), or_dot(F.col("id")) if "id" in have else F.lit("."), "ref", or_dot(F.when(F.size("alt") > 0, F.array_join(F.array_compact("alt"), ","))),
        or_dot(_text(F.col("qual"), T.DoubleType())) if "qual" in have else F.lit("."), filters, F.when(info == "", ".").otherwise(info), F.lit(":".join(["GT", *[f.name.upper() for f in fields]])), F.concat_ws("\t", F.transform("calls", one)),
    )
    return v.df.select("row_idx", "chrom", "pos", line.alias("value"))


def write_vcf(v: Variations, path: str, single: bool = False) -> None:
    """Text in parts, in the order of chromosomes and positions, the header before the first line of the first part; ``single``: one part."""
    head = v.df.sparkSession.createDataFrame([("\n".join(header(v)),)], "value string").select(F.lit(0).alias("_k"), F.lit("").alias("chrom"), F.lit(-1).alias("pos"), F.lit(-1).cast("long").alias("row_idx"), "value")
    lines = head.unionByName(body(v).select(F.lit(1).alias("_k"), "chrom", F.col("pos").cast("int").alias("pos"), "row_idx", "value"))
    order = ("_k", "chrom", "pos", "row_idx")
    lines = lines.repartition(1).sortWithinPartitions(*order) if single else lines.orderBy(*order)
    lines.select("value").write.text(path)
