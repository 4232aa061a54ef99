"""VCF text as a variation table: the header is parsed on the driver, the body by column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.special import bound
from ..operators.table import Variations
from .lines import PLACE, by_file, numbered, placed

_META = re.compile(r'(\w+)=("(?:[^"\\]|\\.)*"|[^,]*)')
_TYPES = {"Integer": "int", "Float": "double", "Flag": "boolean"}


def parse_header(lines: list[str]) -> tuple[dict, list[str]]:
    """Metadata by group (INFO, FORMAT, FILTER, OTHER) and name, and the samples."""
    meta: dict[str, dict] = {"INFO": {}, "FORMAT": {}, "FILTER": {}, "OTHER": {}}
    samples: list[str] = []
    for line in lines:
        if line.startswith("##"):
            key, _, value = line[2:].partition("=")
            if key in ("INFO", "FORMAT", "FILTER") and value.startswith("<"):
                items = {k: x.strip('"') for k, x in _META.findall(value[1:-1])}
                number = items.get("Number")
                if number is not None and number.isdigit():
                    items["Number"] = int(number)
                meta[key][items.pop("ID")] = items
            elif key == "fileformat":
                meta["fileformat"] = value
            else:
                meta["OTHER"][key] = value
        elif line.startswith("#CHROM"):
            samples = line.rstrip("\n").split("\t")[9:]
    return meta, samples


def _scalar(x: Column, kind: str) -> Column:
    x = F.when((x != ".") & (x != ""), x)
    return x if kind == "string" else x.try_cast(kind)


def _typed(x: Column, about: dict) -> Column:
    kind = _TYPES.get(about.get("Type"), "string")
    if kind == "boolean":
        return x.isNotNull()
    if about.get("Number", 1) == 1:
        return _scalar(x, kind)
    return F.when((x != ".") & (x != ""), F.transform(F.split(x, ","), lambda y: _scalar(y, kind)))


def parse_gt(gt: Column) -> Column:
    """Allele numbers; a missing allele is null, and so is the call of a single dot."""
    return F.transform(F.split(gt, "[/|]"), lambda a: a.try_cast("int"))


def read_vcf(spark: SparkSession, path: str, kept_fields: list[str] | None = None, ignored_fields: list[str] | None = None) -> Variations:
    """Reads plain or gzipped text; row_idx follows the order of the file, and of files by their names.

    Fields are named ``info/NAME`` and ``calls/NAME``; a name that the header lacks is refused. Of
    the calls GT, DP, GQ, RO, AO, AD become gt, dp, gq, ro, ao, ad, and any other field its name in
    lower case. FILTER becomes a map of the header's filters: 1 passed, 0 failed; null if not applied.
    """
    if kept_fields is not None and ignored_fields is not None:
        raise ValueError("kept and ignored fields exclude each other")
    text = spark.read.text(path)
    files = by_file(text)
    meta, samples = parse_header(_head(files))
    there = {f"info/{k}" for k in meta["INFO"]} | {f"calls/{k}" for k in meta["FORMAT"]}
    wanted = set(kept_fields if kept_fields is not None else ignored_fields or ())
    if wanted - there:
        raise ValueError(f"fields that the header lacks: {sorted(wanted - there)}")
    keep = lambda f: f in wanted if kept_fields is not None else f not in wanted

    is_variant = lambda rows: rows.where(~F.col("value").startswith("#") & (F.length("value") > 0))
    f = F.split("value", "\t")
    body = placed(text, is_variant).select(*PLACE, f.alias("f")).select(*PLACE, *[F.get("f", F.lit(i)).alias(c) for i, c in enumerate(("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format"))], F.slice("f", 10, max(len(samples), 1)).alias("raw"))
    dot = lambda c: F.when(F.col(c) != ".", F.col(c))
    pairs = F.str_to_map(F.col("info"), F.lit(";"), F.lit("="))
    infos = [_info(pairs, k, about).alias(k) for k, about in meta["INFO"].items() if keep(f"info/{k}")]
    names = [k for k in meta["FORMAT"] if keep(f"calls/{k}") or k == "GT"]
    keys = F.split("format", ":")

    def call(parts: Column, places: Column) -> Column:
        at = lambda k: F.get(parts, places[k])
        fields = [parse_gt(F.coalesce(at("GT"), F.lit("."))).alias("gt")] + [_typed(at(k), meta["FORMAT"][k]).alias(k.lower()) for k in names if k != "GT"]
        return F.struct(*fields)

    passed = F.col("filter") == "PASS"
    failed = F.split("filter", ";")
    filters = F.create_map(*[x for k in meta["FILTER"] for x in (F.lit(k), F.when(F.col("filter") == ".", F.lit(None).cast("int")).when(passed, 1).otherwise((~F.array_contains(failed, k)).cast("int")))]) if meta["FILTER"] else F.lit(None).cast("map<string,int>")
    ploidy = _ploidy([is_variant(x) for x in files])
    missing = F.array(*[F.lit(None).cast("int")] * ploidy)
    # Where a field lies is looked up once for each variant, and a call is split once.
    places = bound({"keys": keys}, lambda s: F.struct(*[F.when(F.array_position(s["keys"], k) > 0, (F.array_position(s["keys"], k) - 1).cast("int")).alias(k) for k in dict.fromkeys(["GT", *names])]))
    parsed = bound({"raw": F.col("raw"), "places": places}, lambda s: F.transform(F.transform(s["raw"], lambda raw: F.split(raw, ":")), lambda parts: call(parts, s["places"])))
    calls = F.transform(parsed, lambda c: c.withField("gt", F.when(F.size(c["gt"]) == ploidy, c["gt"]).otherwise(missing)))
    rows = body.select(
        *PLACE, "chrom", F.col("pos").cast("int").alias("pos"), dot("id").alias("id"), "ref", F.when(F.col("alt") != ".", F.split("alt", ",")).alias("alt"), dot("qual").try_cast("double").alias("qual"),
        filters.alias("filters"), (F.struct(*infos) if infos else F.lit(None).cast("string")).alias("info"), calls.alias("calls"),
    )
    return Variations(numbered(rows), samples, ploidy, metadata=meta)


def _head(files: list[DataFrame]) -> list[str]:
    """The lines before the first variant: the beginning of the first file is read, and of the next if it has no variant."""
    head = []
    for text in files:
        n = 256
        while True:
            lines = [r.value for r in text.take(n)]
            top = [x for x in lines if x.startswith("#")]
            if len(top) < len(lines) or len(lines) < n:
                break
            n *= 4
        head += top
        if len(top) < len(lines):
            break
    return head


def chroms_of(spark: SparkSession, path: str) -> list[str]:
    """The chromosomes of a file, in byte order."""
    rows = _lines(spark, path).select("chrom").distinct()
    return sorted(r.chrom for r in rows.collect())


def lines_of(spark: SparkSession, path: str, chrom: str) -> DataFrame:
    """value: the lines of a chromosome's variants, as they are."""
    return _lines(spark, path).where(F.col("chrom") == chrom).select("value")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.length("value") > 0))
    return rows.select(F.substring_index("value", "\t", 1).alias("chrom"), "value")


def _info(pairs: Column, name: str, about: dict) -> Column:
    if about.get("Type") == "Flag":
        return F.map_contains_key(pairs, name)
    return _typed(F.try_element_at(pairs, F.lit(name)), about)


def _ploidy(files: list[DataFrame]) -> int:
    """Of the first genotype that is called."""
    for lines in files:
        calls = F.split("value", "\t")
        gts = lines.select(F.explode(F.slice(calls, F.lit(10), F.greatest(F.size(calls) - 9, F.lit(0)))).alias("c")).select(F.split(F.split("c", ":")[0], "[/|]").alias("gt"))
        first = gts.where(~F.array_contains("gt", ".")).select(F.size("gt").alias("k")).first()
        if first:
            return first.k
    return 2


def vcf_to_store(spark: SparkSession, path: str, store: str, **fields) -> Variations:
    """Loads a file into a store sorted by chromosome and position; chromosomes are written in parallel."""
    read_vcf(spark, path, **fields).write(store)
    return Variations.read(spark, store)
