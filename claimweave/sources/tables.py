"""Sources and sinks: typed and optional tables, and raw bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType
from pyspark.sql.utils import AnalysisException
from pyspark.sql.window import Window


def scan(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def optional(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table, or an empty one of ``schema`` where it is missing."""
    try:
        return spark.read.parquet(path).select(*[F.col(f.name).cast(f.dataType) for f in schema])
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def typed(df: DataFrame, schema: StructType, required: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected): blank strings become null, values are cast where they can be; rows without a required value are rejected."""
    out = []
    for f in schema:
        value = F.nullif(F.trim(F.col(f.name)), F.lit("")) if isinstance(df.schema[f.name].dataType, StringType) else F.col(f.name)
        out.append(value.try_cast(f.dataType).alias(f.name))
    mapped = df.select(*out)
    whole = F.lit(True)
    for r in required:
        whole = whole & F.col(r).isNotNull()
    return mapped.where(whole), mapped.where(~whole)


#: Record fields by table: name and type; ! marks required ones.  A timestamp that is required must be readable.
RECORDS = {
    "sources": "id string!, name string!, domain string, source_type string!, source_quality string!, enabled boolean!, metadata json, created_at timestamp!, updated_at timestamp!",
    "entities": "id string!, entity_type string!, canonical_name string!, slug string!, description string, country_code string, metadata json, created_at timestamp!, updated_at timestamp!",
    "entity_aliases": "id string!, entity_id string!, alias string!, language string, valid_from string, valid_to string, source_id string, created_at timestamp!",
    "documents": "id string!, source_id string!, original_url string!, canonical_url string, title string, author string, publisher string, published_at timestamp, retrieved_at timestamp!, content_type string, language string, raw_storage_path string, extracted_text string, content_hash string, http_status int, access_status string!, extraction_status string!, metadata json, created_at timestamp!, updated_at timestamp!",
    "claims": "id string!, subject_entity_id string!, predicate string!, object_entity_id string, literal_value json, connection_class string!, valid_from string, valid_to string, confidence_score double, evidence_score double, validation_notes json, verification_status string!, created_by string!, reviewed_by string, reviewed_at timestamp, supersedes_claim_id string, created_at timestamp!, updated_at timestamp!",
    "claim_evidence": "id string!, claim_id string!, document_id string!, evidence_text string!, context_before string, context_after string, start_char int, end_char int, page_number int, section string, evidence_hash string!, created_at timestamp!",
}


def json_record(text: Column) -> Column:
    """The text of a JSON object; anything else, null included, is an empty one."""
    parsed = F.try_parse_json(text)
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), text).otherwise("{}")


def records(df: DataFrame, table: str, strict: bool = True) -> DataFrame:
    """``df``'s rows as records of ``table``: blank strings are null, unreadable optional values too; columns it lacks are null.

    A required value that is missing or unreadable is an error when the row is read; unless ``strict``, such rows are
    given an error column instead.
    """
    out, errors = [], []
    for field in RECORDS[table].split(", "):
        name, kind = field.rstrip("!").split(" ")
        given = F.col(name) if name in df.columns else F.lit(None).cast("string")
        text = F.when(F.trim(given.cast("string")) != "", given.cast("string"))
        value = json_record(given.cast("string")) if kind == "json" else text if kind == "string" else text.try_cast(kind)
        if field.endswith("!"):
            what = {"string": "non-empty string", "boolean": "boolean", "timestamp": "valid date"}[kind]
            told = F.lit(f"Expected {name} to be a {what}.")
            errors.append(F.when(value.isNull(), told))
            if strict:
                value = F.coalesce(value, F.raise_error(told).cast(kind))
        out.append(value.alias(name))
    return df.select(*out) if strict else df.select(*out, F.coalesce(*errors).alias("error"))


def lookup(df: DataFrame, value: object, key: str = "id") -> DataFrame:
    """The row of one key, as a filter that is pushed to the scan."""
    return df.where(F.col(key) == F.lit(value))


def at_most_one(df: DataFrame) -> DataFrame:
    """``df`` itself, if it has no more than one row."""
    if len(df.limit(2).collect()) > 1:
        raise ValueError("more than one row")
    return df


def apply_changes(base: DataFrame, changes: DataFrame, key: str = "id", upsert: bool = False) -> DataFrame:
    """``base`` after ``changes``, whole rows of the same columns of which the one of the greatest ``change`` number counts.

    Without ``upsert``, a change of an unknown key is an error.
    """
    last = changes.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("change")))).where("__n = 1").drop("__n", "change")
    if not upsert and last.join(base, key, "left_anti").limit(1).count():
        raise ValueError("a change of an unknown row")
    return base.join(last.select(key), key, "left_anti").unionByName(last.select(*base.columns))


def public_base(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables that the public graph is made of, with rows whose references do not resolve left out; nothing is loaded yet."""
    from ..operators.integrity import cascade

    kept = cascade(*(tables[t] for t in ("entities", "aliases", "sources", "documents", "claims", "evidence")))
    return {"sources": tables["sources"], "entities": tables["entities"], **kept}


def write_bodies(df: DataFrame, path: str) -> None:
    """Raw bodies (path, body) as a table dealt out by source type, the second part of their path.

    A path that is there already is an error, as is one given twice: bodies are never overwritten.  For one writer at a time; the data source
    of ``bodies`` puts each body as an object of its own and is safe for any number.
    """
    spark = df.sparkSession
    given = df.groupBy("path").count().where("count > 1").limit(1).count()
    there = optional(spark, path, StructType().add("path", "string")).join(df.select("path"), "path", "left_semi").limit(1).count()
    if given or there:
        raise ValueError("a raw document of this path exists")
    df.withColumn("source", F.split("path", "/")[1]).write.partitionBy("source").mode("append").parquet(path)
