"""Distributed readers. Each is one splittable scan with an explicit schema; a missing optional modality is None."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortia.operators.reshape import best_row, functional_variants, melt

# fixed values: variant classes that change the protein
FUNCTIONAL_CLASSES = ["Missense_Mutation", "Nonsense_Mutation", "Frame_Shift_Del", "Frame_Shift_Ins", "Splice_Site", "In_Frame_Del",
                      "In_Frame_Ins", "Translation_Start_Site", "Nonstop_Mutation"]


@dataclass
class Cohort:
    """The tables of one cohort. Absent modalities stay None, never an empty frame."""

    expression: DataFrame
    metadata: DataFrame
    mutation: DataFrame | None = None
    cna: DataFrame | None = None
    methylation: DataFrame | None = None
    rppa: DataFrame | None = None
    crispr: DataFrame | None = None
    drug_response: DataFrame | None = None
    extra: dict[str, DataFrame] = field(default_factory=dict)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence test through Hadoop's file system, so it works on any store; globs count when they match."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    hits = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return hits is not None and len(hits) > 0


def pick_column(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """First candidate name that the table has (case-insensitive)."""
    have = {c.strip().lower(): c for c in df.columns}
    return next((have[c.lower()] for c in candidates if c.lower() in have), None)


def keep_present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def read_matrix(spark: SparkSession, path: str, id_column: str) -> DataFrame | None:
    """Samples x features Parquet -> long (sample_id, feature, value); None when absent."""
    if not path_exists(spark, path):
        return None
    return melt(spark.read.parquet(path).withColumnRenamed(id_column, "sample_id"), ["sample_id"])


def read_omics_csv(spark: SparkSession, path: str, id_column: str = "ModelID", flag_column: str = "IsDefaultEntryForModel",
                   meta_columns: Sequence[str] = ()) -> DataFrame:
    """Omics CSV in either layout: id as first unnamed column, or id column plus metadata and a default-row flag."""
    df = spark.read.option("header", True).csv(path)
    if id_column in df.columns:
        if flag_column in df.columns:
            df = df.where(F.col(flag_column) == "Yes")
        drop = {flag_column, *meta_columns, df.columns[0]} - {id_column}
        df = df.select(F.col(id_column).alias("sample_id"), *[F.col(f"`{c}`") for c in df.columns if c != id_column and c not in drop])
    else:
        df = df.withColumnRenamed(df.columns[0], "sample_id")
    values = [c for c in df.columns if c != "sample_id"]
    df = df.select("sample_id", *[F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c) for c in values])
    return melt(df, ["sample_id"])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest JSON -> (file_id, file_name, sample_id)."""
    schema = "file_id string, file_name string, cases array<struct<submitter_id:string>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(
        "file_id", "file_name", F.try_element_at("cases", F.lit(1))["submitter_id"].alias("sample_id"))


def read_sample_files(spark: SparkSession, path: str, manifest: DataFrame, value_column: str, gene_column: str = "gene_name",
                      type_column: str = "gene_type", gene_type: str | None = "protein_coding", log1p: bool = True,
                      file_key: str = r"([^/]+)$") -> DataFrame:
    """Many per-sample TSVs -> long expression. One scan; the part of the path that ``file_key`` captures (the file name by
    default) is the join key to the manifest's file_name; duplicate symbols within a sample are summed before the log."""
    df = spark.read.option("header", True).option("sep", "\t").option("comment", "#").option("recursiveFileLookup", True).csv(path)
    df = df.withColumn("file_name", F.regexp_extract(F.col("_metadata.file_path"), file_key, 1))
    if gene_type is not None:
        df = df.where(F.col(type_column) == gene_type)
    df = df.where(F.col(gene_column).isNotNull()).select("file_name", F.col(gene_column).alias("feature"), F.expr(f"try_cast({value_column} AS DOUBLE)").alias("value"))
    out = df.join(manifest.select("file_name", "sample_id"), "file_name").groupBy("sample_id", "feature").agg(F.sum("value").alias("value"))
    return out.withColumn("value", F.log1p("value")) if log1p else out


def read_clinical(spark: SparkSession, path: str, samples: DataFrame, id_column: str = "sample_id") -> DataFrame:
    """Clinical TSV left-joined on the cohort's samples."""
    c = spark.read.option("header", True).option("sep", "\t").csv(path).withColumnRenamed(id_column, "sample_id")
    return samples.select("sample_id").distinct().join(c, "sample_id", "left")


CASE_SCHEMA = ("submitter_id string, demographic struct<gender:string,race:string,vital_status:string,days_to_death:double>, "
               "diagnoses array<struct<primary_diagnosis:string,tumor_stage:string,age_at_diagnosis:double,days_to_last_follow_up:double>>")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Nested case JSON -> one flat clinical row; only the first diagnosis counts."""
    c = spark.read.schema(CASE_SCHEMA).option("multiLine", True).json(path)
    return flatten_cases(c)


def flatten_cases(cases: DataFrame) -> DataFrame:
    x = cases.withColumn("_d", F.try_element_at("diagnoses", F.lit(1)))
    return x.select(F.col("submitter_id").alias("sample_id"), "demographic.*", "_d.*")


def read_maf(spark: SparkSession, path: str, classes: Sequence[str] = tuple(FUNCTIONAL_CLASSES), width: int = 12) -> DataFrame:
    """MAF text -> distinct (sample_id, gene) of functional variants; barcodes cut to ``width`` characters."""
    m = spark.read.option("header", True).option("sep", "\t").option("comment", "#").csv(path)
    v = functional_variants(m.withColumnRenamed("Variant_Classification", "variant_class"), classes)
    return v.select(F.substring("Tumor_Sample_Barcode", 1, width).alias("sample_id"), F.col("Hugo_Symbol").alias("gene")).where("gene IS NOT NULL").distinct()


def parse_gmt(lines: DataFrame, line: str = "value") -> DataFrame:
    """Lines name<TAB>url<TAB>genes... -> (collection, set_name, gene); short lines drop, names upper-cased."""
    p = F.split(F.trim(line), "\t")
    x = lines.withColumn("_p", p).where(F.size("_p") >= 3)
    coll = [F.col("collection")] if "collection" in lines.columns else []
    return x.select(*coll, F.upper(F.col("_p")[0]).alias("set_name"), F.explode(F.slice("_p", 3, F.size("_p"))).alias("gene")).where("gene <> ''").distinct()


def read_gmt(spark: SparkSession, path: str) -> DataFrame:
    t = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.gmt").text(path)
    return parse_gmt(t.withColumn("collection", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.gmt$", 1)))


def read_long_files(spark: SparkSession, path: str, manifest: DataFrame, names: tuple[str, str] = ("feature", "value")) -> DataFrame:
    """Headerless two-column files, one per sample -> long table through the file name."""
    schema = T.StructType([T.StructField(names[0], T.StringType()), T.StructField(names[1], T.StringType())])
    t = spark.read.schema(schema).option("sep", "\t").csv(path).withColumn("file_name", F.col("_metadata.file_name"))
    return t.join(manifest.select("file_name", "sample_id"), "file_name").select("sample_id", names[0], F.expr(f"try_cast({names[1]} AS DOUBLE)").alias(names[1])).where(F.col(names[1]).isNotNull())


def read_peak_calls(spark: SparkSession, path: str, meta_columns: Sequence[str] = ("Unique Name", "Descriptor", "Wide Peak Limits", "Peak Limits", "Region Limits", "q values", "Residual q values after removing segments shared with higher peaks", "Broad or Focal", "Amplitude Threshold")) -> DataFrame:
    """Peak x sample matrix -> (sample_id, peak, kind, level). Rows of raw copy values are dropped."""
    t = spark.read.option("header", True).option("sep", "\t").csv(path)
    t = t.where(~F.col("Unique Name").contains("CN values"))
    kind = F.when(F.col("Unique Name").startswith("Amplification"), "amp").when(F.col("Unique Name").startswith("Deletion"), "del")
    cols = [c for c in t.columns if c not in meta_columns and not c.startswith("_c")]
    w = t.select(kind.alias("kind"), F.trim("Descriptor").alias("peak"), *[F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c) for c in cols])
    return w.where("kind IS NOT NULL").unpivot(["kind", "peak"], cols, "sample_id", "level").where("level IS NOT NULL")


def read_peak_genes(spark: SparkSession, path: str, kind: str, head_rows: int = 4) -> DataFrame:
    """Per-peak gene columns (first row cytobands, then statistics, then genes) -> (kind, peak, gene). Non-genes drop.

    A line is a rank across peaks; lines are labelled in their first column, so statistic rows are told apart by label.
    """
    t = spark.read.option("sep", "\t").csv(path)
    n = len(t.columns)
    stats = ["cytoband", "q value", "residual q value", "wide peak boundaries"][:head_rows]
    band = t.where(F.col("_c0") == "cytoband").select(F.posexplode(F.array(*[F.trim(f"_c{i}") for i in range(1, n)])).alias("i", "peak"))
    body = t.where(~F.coalesce("_c0", F.lit("")).isin(stats)).select(F.posexplode(F.array(*[F.trim(f"_c{i}") for i in range(1, n)])).alias("i", "gene"))
    g = body.where("gene IS NOT NULL AND gene <> ''").where(~F.col("gene").startswith("LOC") & ~F.col("gene").startswith("hsa-"))
    return g.join(F.broadcast(band), "i").where("peak IS NOT NULL").select(F.lit(kind).alias("kind"), "peak", "gene").distinct()


def read_gene_calls(spark: SparkSession, path: str, symbol: str = "Hugo_Symbol", drop: Sequence[str] = ("Entrez_Gene_Id",), width: int = 12) -> DataFrame:
    """Gene-level call matrix -> (sample_id, gene, call TINYINT or null); the first row of a repeated symbol wins."""
    t = spark.read.option("header", True).option("sep", "\t").csv(path)
    cols = [c for c in t.columns if c not in (symbol, *drop)]
    first = best_row(t.where(F.col(symbol).isNotNull()).select(F.col(symbol).alias("gene"), F.monotonically_increasing_id().alias("_row"), *[F.col(f"`{c}`") for c in cols]), ["gene"], [F.col("_row")])
    w = first.select("gene", *[F.expr(f"try_cast(round(try_cast(`{c}` AS DOUBLE)) AS TINYINT)").alias(c) for c in cols])
    return w.unpivot("gene", cols, "sample_id", "call").withColumn("sample_id", F.substring("sample_id", 1, width))


def read_reference(spark: SparkSession, paths: Sequence[str], columns: dict[str, Sequence[str]], sep: str = "\t", skip_until: str | None = None) -> DataFrame | None:
    """First existing of several release files, with aliased columns resolved by name and missing ones left out.

    ``columns`` maps output name -> candidate names. ``skip_until``: header lines before the one that starts with this text
    are filtered by content.
    """
    path = next((p for p in paths if path_exists(spark, p)), None)
    if path is None:
        return None
    if skip_until is None:
        df = spark.read.option("header", True).option("sep", sep).csv(path)
    else:
        lines = spark.read.text(path)
        head = lines.where(F.col("value").startswith(skip_until)).first()[0]
        names = head.split(sep)
        body = lines.where(F.size(F.split("value", sep)) >= len(names)).where(F.col("value") != head)
        df = body.select(*[F.split("value", sep)[i].alias(n) for i, n in enumerate(names)])
    found = {out: pick_column(df, names) for out, names in columns.items()}
    return df.select(*[F.col(f"`{c}`").alias(o) for o, c in found.items() if c])


def read_drug_matrix(spark: SparkSession, samples_by_drugs: str, drugs_by_samples: str) -> DataFrame | None:
    """Drug response in whichever orientation exists -> (sample_id, feature = drug, value)."""
    if path_exists(spark, samples_by_drugs):
        df, swap = spark.read.option("header", True).csv(samples_by_drugs), False
    elif path_exists(spark, drugs_by_samples):
        df, swap = spark.read.option("header", True).csv(drugs_by_samples), True
    else:
        return None
    df = df.withColumnRenamed(df.columns[0], "_id")
    df = df.select("_id", *[F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c) for c in df.columns if c != "_id"])
    long = melt(df, ["_id"])
    a, b = ("feature", "_id") if swap else ("_id", "feature")
    return long.select(F.col(a).alias("sample_id"), F.col(b).alias("feature"), "value")


def read_census(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Large census TSV: a splittable scan of the needed columns only."""
    return spark.read.option("header", True).option("sep", "\t").csv(path).select(*columns)


# ---- episodes and verdicts ----------------------------------------------------------------------------------------

BLOCK = "array<struct<type:string,text:string,thinking:string,reasoning:string,name:string,id:string,input:string,tool_use_id:string,content:string>>"
EPISODE_SCHEMA = ("cohort string, model string, discovery struct<proposed_grouping:string,top_genes:array<string>,pathway_evidence:array<string>,"
                  "mechanism_hypothesis:string,confidence:string,next_experiment:string,data_lock_report:string>, "
                  "messages array<struct<role:string,content:string>>, wall_time_s double, "
                  "run_log struct<usage_log:array<struct<turn:int,input_tokens:bigint,output_tokens:bigint,api_s:double,retries:int>>,"
                  "timing_log:array<struct<call_num:int,exec_time_s:double,output_chars:bigint,is_error:boolean,timed_out:boolean>>>")
DERIVED = r"(scores|trace|summary|verdict|cot)"


def read_episodes(spark: SparkSession, path: str, derived: str = DERIVED) -> DataFrame:
    """Episode JSON files <run>/<label>/<label>.json. Missing fields are null; derived artefacts are skipped by name; a file
    counts only when it lies in the folder of its own label."""
    e = spark.read.schema(EPISODE_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    parts = F.split(F.col("_metadata.file_path"), "/")
    e = e.withColumn("episode", F.regexp_replace(F.element_at(parts, -1), r"\.json$", "")).withColumn("_dir", F.element_at(parts, -2))
    e = e.withColumn("run", F.try_element_at(parts, F.lit(-3)))
    return e.where((F.col("episode") == F.col("_dir")) & ~F.lower("episode").rlike(derived)).drop("_dir")


def message_blocks(episodes: DataFrame) -> DataFrame:
    """Messages -> one row per content block. Content may be a string or a list; a result's content likewise."""
    m = episodes.select("episode", F.posexplode("messages").alias("msg_ix", "m")).select("episode", "msg_ix", "m.role", F.col("m.content").alias("raw"))
    is_list = F.ltrim("raw").startswith("[")
    none = F.lit(None).cast("string")
    names = ("thinking", "reasoning", "name", "id", "input", "tool_use_id", "content")
    one = F.array(F.struct(F.lit("text").alias("type"), F.col("raw").alias("text"), *[none.alias(n) for n in names])).cast(BLOCK)
    b = m.withColumn("_b", F.when(is_list, F.from_json("raw", BLOCK)).otherwise(one))
    x = b.select("episode", "msg_ix", "role", F.posexplode("_b").alias("block_ix", "b"))
    parts = F.from_json("b.content", "array<struct<text:string>>")
    content = F.when(F.ltrim("b.content").startswith("["), F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), " ")).otherwise(F.col("b.content"))
    code = F.coalesce(F.get_json_object("b.input", "$.code"), F.col("b.input"))
    return x.select("episode", F.col("msg_ix").cast("long").alias("msg_ix"), "block_ix", "role", "b.type", F.coalesce("b.text", "b.thinking", "b.reasoning").alias("text"),
                    "b.name", "b.id", code.alias("input"), F.col("b.input").alias("input_json"), "b.tool_use_id", content.alias("content"))


def grouping_table(episodes: DataFrame) -> DataFrame:
    """(episode, sample_id, label) from the proposed grouping map."""
    g = F.from_json("discovery.proposed_grouping", "map<string,string>")
    return episodes.select("episode", F.explode(g).alias("sample_id", "label"))


def run_log_tables(episodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(usage, timing, wall) event tables of the run logs."""
    u = episodes.select("episode", F.posexplode("run_log.usage_log").alias("turn_ix", "u")).select("episode", "turn_ix", "u.*")
    t = episodes.select("episode", F.explode("run_log.timing_log").alias("t")).select("episode", "t.*")
    return u, t, episodes.select("episode", F.col("wall_time_s").alias("wall_s"))


def read_verdicts(spark: SparkSession, path: str, suffix: str, pass_id: str) -> DataFrame:
    """Side-car verdict files by suffix -> (episode, pass, fields map); files outside their own episode folder drop; broken
    JSON gives a null map, so integrity checks still see the file."""
    t = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").text(path)
    parts = F.split(F.col("_metadata.file_path"), "/")
    label = F.replace(F.element_at(parts, -1), F.lit(suffix), F.lit(""))
    t = t.select(label.alias("episode"), F.element_at(parts, -2).alias("_dir"), F.from_json("value", "map<string,string>").alias("fields"))
    return t.where("episode = _dir").select("episode", F.lit(pass_id).alias("pass"), "fields")
