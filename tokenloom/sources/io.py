"""Sources and sinks: packs, ground truth, notes, per-request CSV, result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pages import load_pages

NOTES = "turn long, text string"
EXPECTED = (
    "member map<string,string>, treatment map<string,string>, diagnoses array<struct<icd10:string,description:string,primary:boolean>>, "
    "procedures array<struct<code:string,description:string,date:string>>, pre_authorisation struct<reference:string,approved_amount:double,status:string>, "
    "invoices array<struct<provider:string,invoice_number:string,date:string,amount:double>>, totals struct<currency:string,total_billed:double,exceeds_pre_authorisation:boolean>"
)
SLOTS = ("slot_system", "slot_memory", "slot_documents", "slot_history", "slot_query")


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet", pack: str = "pack_id", page_no: str = "page_no", text: str = "text") -> DataFrame:
    return load_pages(spark.read.format(fmt).load(path), pack, page_no, text)


def read_ground_truth(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(pack, expected, evidence) from JSON files, one pack each; the pack is the file's name. With ``lines`` every line is a pack and names it as ``pack_id``."""
    schema = f"expected struct<{', '.join(f'{n}:{t}' for n, t in (x.split(' ', 1) for x in EXPECTED.split(', ')))}>, evidence map<string,array<string>>"
    pack = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.json)?$", 1)
    if lines:
        return spark.read.schema(f"pack_id string, {schema}").json(path)
    return spark.read.schema(schema).json(path, multiLine=True).select(pack.alias("pack_id"), "expected", "evidence")


def evidence(truth: DataFrame) -> DataFrame:
    """(pack_id, field_key, phrase) of ground truth."""
    keyed = truth.select("pack_id", F.explode("evidence").alias("field_key", "phrases"))
    return keyed.select("pack_id", "field_key", F.explode("phrases").alias("phrase"))


def read_notes(spark: SparkSession, path: str, arrays: bool = False) -> DataFrame:
    """(turn, text) of notes: JSON lines as ``append_notes`` writes them, or with ``arrays`` files that each hold one JSON array."""
    return spark.read.schema(NOTES).json(path, multiLine=arrays)


def append_notes(notes: DataFrame, path: str) -> None:
    """Adds a line of JSON for each note; what is there already stays."""
    notes.select("turn", "text").write.mode("append").json(path)


def write_requests_csv(contexts: DataFrame, path: str) -> None:
    """Slot columns in their order; a missing slot is 0."""
    present = [F.coalesce(F.col(s), F.lit(0)).alias(s) if s in contexts.columns else F.lit(0).alias(s) for s in SLOTS]
    contexts.select("conv_id", "request_id", "strategy", *present, "tokens").write.mode("overwrite").option("header", True).csv(path)


def write_rows_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
