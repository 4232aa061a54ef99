"""Small tables from lists of genotypes; -1 is a missing allele."""

from genomill.operators.table import Variations

CALL = "struct<gt:array<int>,dp:int,gq:int,ro:int,ao:array<int>,ad:array<int>>"


def table(spark, gts, chrom=None, pos=None, samples=None, pops=None, ref=None, alt=None, qual=None, dp=None, ad=None, ro=None, ao=None):
    rows = []
    for i, calls in enumerate(gts):
        cells = []
        for j, gt in enumerate(calls):
            pick = lambda x, i=i, j=j: None if x is None else x[i][j]
            cells.append(([None if a < 0 else a for a in gt], pick(dp), None, pick(ro), pick(ao), pick(ad)))
        rows.append((i, "1" if chrom is None else chrom[i], i + 1 if pos is None else pos[i], None, "A" if ref is None else ref[i], ["C", "G", "T"] if alt is None else alt[i], None if qual is None else float(qual[i]), cells))
    df = spark.createDataFrame(rows, f"row_idx long, chrom string, pos int, id string, ref string, alt array<string>, qual double, calls array<{CALL}>")
    n = len(gts[0]) if gts else 0
    return Variations(df, samples or [f"s{k}" for k in range(n)], len(gts[0][0]) if gts else 2, pops or {})


def column(df, name, key="row_idx"):
    return [r[name] for r in df.orderBy(key).collect()]
