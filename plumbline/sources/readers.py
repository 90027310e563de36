"""Reading the prepared formats: sequence files, annotation and assay tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.gates import GateError, duplicated, union

#: Labels, solubility codes, and the columns that the tables must have.
LABELS = ("Cell.membrane", "Cytoplasm", "Endoplasmic.reticulum", "Extracellular", "Golgi.apparatus", "Lysosome/Vacuole", "Mitochondrion", "Nucleus", "Peroxisome", "Plastid")
DUAL = "Cytoplasm-Nucleus"
SOLUBILITY = ("M", "S", "U")
ANNOTATION_NAMES = {
    "Entry": "entry_accession", "Function [CC]": "function_text", "Gene Ontology (cellular component)": "go_component",
    "Gene Ontology (biological process)": "go_process", "Gene Ontology (molecular function)": "go_function", "Keywords": "keywords",
}
REFERENCE_SCHEMA = "DMS_id string, taxon string, target_seq string, seq_len int, includes_multiple_mutants boolean, DMS_number_single_mutants int"
VARIANT_COLUMNS = ("mutant", "mutated_sequence", "DMS_score", "fold_random_5", "fold_modulo_5", "fold_contiguous_5")


def read_labelled_fasta(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of a file or folder. Records: accession, sequence, localization, solubility, is_test.

    A record is a header behind ``>`` and lines of letters. Rejects (header, reason) have an empty or other sequence, a
    malformed header, an accession that stands twice, or come before any header. No record at all is an error.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.col("value").alias("v"))
    # only the first record of a file keeps its mark
    first = F.col("v").startswith(">")
    body = F.when(first, F.substring("v", 2, 2**31 - 1)).otherwise(F.col("v"))
    split = raw.select(body.alias("v"), F.input_file_name().alias("_file"), F.monotonically_increasing_id().alias("_id"), first.alias("_marked"))
    head = F.trim(F.substring_index("v", "\n", 1))
    records = split.select(
        head.alias("header"),
        F.upper(F.regexp_replace(F.when(F.instr("v", "\n") > 0, F.expr("substring(v, instr(v, '\n') + 1)")).otherwise(""), r"\s", "")).alias("sequence"),
        "_marked", "_file", "_id",
    )
    pattern = r"^(\S+)\s+(\S+)-([MSU])(\s+test)?$"
    part = lambda i: F.regexp_extract("header", pattern, i)
    firsts = records.groupBy("_file").agg(F.min_by("_marked", "_id").alias("_file_marked"), F.min("_id").alias("_first"))
    parsed = records.join(F.broadcast(firsts), "_file").select("header", "sequence", part(1).alias("accession"), part(2).alias("localization"), part(3).alias("solubility"), (part(4) != "").alias("is_test"), (~F.col("_file_marked") & (F.col("_id") == F.col("_first"))).alias("_early"))
    parsed = parsed.where(~(F.col("_early") & (F.col("header") == "") & (F.col("sequence") == "")))
    twice = duplicated(parsed.where("accession <> ''"), "accession").select("accession", F.lit(True).alias("_twice"))
    reason = (
        F.when(F.col("_early"), "data before a header")
        .when(F.col("accession") == "", "malformed header")
        .when(~F.col("localization").isin(*LABELS, DUAL), "unknown label")
        .when(~F.col("sequence").rlike("^[A-Z]+$"), "empty or malformed sequence")
        .when(F.coalesce("_twice", F.lit(False)), "accession stands twice")
    )
    judged = parsed.join(twice, "accession", "left").withColumn("reason", reason)
    if not judged.take(1):
        raise GateError(f"no record in {path}")
    return judged.where("reason is null").select("accession", "sequence", "localization", "solubility", "is_test"), judged.where("reason is not null").select("header", "reason")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """entry_accession and five text columns: tab-separated, no quoting, all text, empty rather than null; the first of equal entries by file and content."""
    names = list(ANNOTATION_NAMES)
    raw = spark.read.csv(path, sep="\t", header=True, quote="", enforceSchema=False, schema=T.StructType([T.StructField(n, T.StringType()) for n in names]))
    clean = raw.select(*[F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(ANNOTATION_NAMES[n]) for n in names], F.input_file_name().alias("_file"))
    order = F.struct("_file", *[c for c in ANNOTATION_NAMES.values() if c != "entry_accession"])
    return clean.groupBy("entry_accession").agg(F.min(order).alias("_r")).select("entry_accession", *[F.col(f"_r.{c}") for c in ANNOTATION_NAMES.values() if c != "entry_accession"])


def read_assay_reference(spark: SparkSession, path: str) -> DataFrame:
    """The assay reference with its declared types; a missing column is an error."""
    there = spark.read.csv(path, header=True).columns
    if lack := [f.split()[0] for f in REFERENCE_SCHEMA.split(", ") if f.split()[0] not in there]:
        raise GateError(f"columns {lack} are missing")
    raw = spark.read.csv(path, header=True)
    return raw.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in REFERENCE_SCHEMA.split(", ")])


def read_assays(spark: SparkSession, folder: str, ids: list[str]) -> DataFrame:
    """The variants of the listed assays only, one file each, tagged with dms_id; a missing file or column is an error.

    One job finds all headers, and one scan reads all files that have the same header, however many assays there are.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = {s.getPath().getName(): s.getPath().toString() for s in fs.listStatus(at)} if fs.exists(at) else {}
    if lack := [i for i in ids if f"{i}.csv" not in there]:
        raise GateError(f"assays {lack} are missing")
    if not ids:
        raise GateError("no assay is listed")
    paths = {i: there[f"{i}.csv"] for i in dict.fromkeys(ids)}
    file = F.coalesce(F.nullif(F.regexp_extract("_metadata.file_path", r"([^/]+)\.csv/[^/]*$", 1), F.lit("")), F.regexp_extract("_metadata.file_path", r"([^/]+)\.csv$", 1))
    named = F.expr("url_decode(replace(_file, '+', '%2B'))")
    fields = F.transform(F.split("value", ","), lambda c: F.btrim(c, F.lit('" \r')))
    lines = spark.read.text(list(paths.values())).select("value", file.alias("_file")).select("value", named.alias("dms_id"))
    heads = lines.where(F.size(F.array_intersect(fields, F.lit(list(VARIANT_COLUMNS)))) > 1).groupBy("dms_id").agg(F.min(fields).alias("names")).collect()  # a row a file
    names = {r.dms_id: tuple(r.names) for r in heads}
    lacking = {i: [c for c in VARIANT_COLUMNS if c not in names.get(i, ())] for i in paths}
    if bad := {i: c for i, c in lacking.items() if c}:
        raise GateError("; ".join(f"assay {i} lacks {c}" for i, c in sorted(bad.items())))
    kinds = {"DMS_score": "double"} | {c: "int" for c in VARIANT_COLUMNS if c.startswith("fold_")}
    frames = []
    for layout in sorted(set(names.values())):
        own = [paths[i] for i in paths if names[i] == layout]
        schema = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(layout))])
        rows = spark.read.csv(own, header=True, schema=schema).select("*", file.alias("_file"))
        frames.append(rows.select(named.alias("dms_id"), *[F.col(f"c{layout.index(c)}").cast(kinds.get(c, "string")).alias(c) for c in VARIANT_COLUMNS]))
    return union(*frames)


def read_prepared(spark: SparkSession, path: str, **equal: object) -> DataFrame:
    """A prepared table; conditions on partition columns prune what is read."""
    df = spark.read.parquet(path)
    for column, value in equal.items():
        df = df.where(F.col(column) == value)
    return df


def read_results(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All of the result tables that exist; none is an error."""
    frames = []
    for path in paths:
        try:
            frames.append(spark.read.csv(path, header=True, inferSchema=True))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return union(*frames, tolerant=True)


