"""Queries that write tables in the library's formats and read them back, and the stream of session compaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import io
from ..sources.scratch import scratch_folder
from ..streaming.compaction import OUTPUT, compact_stream
from . import sqltext as S
from .pages_catalog import read
from .sessions_catalog import ORACLE_SQL as SESSION_SQL
from .sessions_catalog import PLAN, assemble_truncated, messages, notes, request_history

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def stored_pages(spark, sf_dir):
    path = scratch_folder(spark)
    read(spark, sf_dir, "documents").select("lang", "doc_id", "text").write.json(path)
    return io.read_pages(spark, path, "json", "lang", "doc_id", "text").select("pack_id", F.col("page_no").cast("long").alias("page_no"), "text")


def stored_truth(spark, sf_dir):
    """Each order with its lines as a pack's expected values and the phrases that prove them."""
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.array_sort(F.collect_list(F.struct(F.concat_ws("-", F.lit("INV"), "l_linenumber", "l_partkey").alias("invoice_number"), F.col("l_extendedprice").cast("double").alias("amount")))).alias("invoices")
    )
    orders = read(spark, sf_dir, "orders").join(lines, "o_orderkey")
    member = F.create_map(F.lit("status"), "o_orderstatus")
    shown = F.map_from_arrays(F.array(F.lit("member.status"), F.lit("invoices")), F.array(F.array("o_orderstatus"), F.col("invoices.invoice_number")))
    total = F.struct(F.lit("HKD").alias("currency"), F.col("o_totalprice").cast("double").alias("total_billed"))
    path = scratch_folder(spark)
    orders.select(F.concat(F.lit("p"), "o_orderkey").alias("pack_id"), F.struct(member.alias("member"), "invoices", total.alias("totals")).alias("expected"), shown.alias("evidence")).write.json(path)
    truth = io.read_ground_truth(spark, path, lines=True)
    told = truth.select("pack_id", F.col("expected.totals.total_billed").alias("total_billed"), F.size("expected.invoices").cast("long").alias("n_invoices"))
    return io.evidence(truth).join(told, "pack_id")


def stored_notes(spark, sf_dir):
    """Notes appended in two goes."""
    path, told = scratch_folder(spark), notes(spark, sf_dir)
    io.append_notes(told.where("turn < 3"), path)
    io.append_notes(told.where("turn >= 3"), path)
    return io.read_notes(spark, path)


def stored_requests(spark, sf_dir):
    path = scratch_folder(spark)
    io.write_requests_csv(assemble_truncated(spark, sf_dir).drop("slot_memory"), path)
    numbers = ", ".join(f"{c} long" for c in (*io.SLOTS, "tokens"))
    kinds = ", ".join(numbers.split(", ")[:-1])
    return spark.read.schema(f"conv_id long, request_id long, strategy string, {kinds}, tokens long").option("header", True).csv(path)


def stored_rows(spark, sf_dir):
    path = scratch_folder(spark)
    io.write_rows_json(request_history(spark, sf_dir), path)
    return spark.read.schema("conv_id long, request_id long, n_messages long, history_tokens long").json(path)


def stream_sessions(spark, sf_dir):
    """All messages through the stream; its rows as its sink has them."""
    base, told = scratch_folder(spark), messages(spark, sf_dir).withColumn("conv_id", F.col("conv_id").cast("long"))
    told.write.parquet(f"{base}/in")
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        stream = compact_stream(spark.readStream.schema(told.schema).parquet(f"{base}/in"), PLAN)
        stream.writeStream.format("json").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    return spark.read.schema(OUTPUT).json(f"{base}/out")


QUERIES = {f.__name__: f for f in (stored_pages, stored_truth, stored_notes, stored_requests, stored_rows, stream_sessions)}

ORACLE_SQL = {
    "stored_pages": "SELECT lang AS pack_id, doc_id AS page_no, coalesce(text, '') AS text FROM documents",
    "stored_truth": """WITH l AS (SELECT l_orderkey, 'INV-' || l_linenumber || '-' || l_partkey AS inv FROM lineitem), c AS (SELECT l_orderkey, count(*) AS n_invoices FROM l GROUP BY ALL),
e AS (SELECT l_orderkey AS k, 'invoices' AS field_key, inv AS phrase FROM l UNION ALL SELECT o_orderkey, 'member.status', o_orderstatus FROM orders)
SELECT 'p' || o_orderkey AS pack_id, field_key, phrase, o_totalprice::DOUBLE AS total_billed, n_invoices FROM orders JOIN c ON l_orderkey = o_orderkey JOIN e ON k = o_orderkey""",
    "stored_notes": f"SELECT turn, text FROM ({S.NOTES})",
    "stored_requests": f"SELECT conv_id, request_id, strategy, slot_system, 0::BIGINT AS slot_memory, slot_documents, slot_history, slot_query, tokens FROM ({SESSION_SQL['assemble_truncated']})",
    "stored_rows": SESSION_SQL["request_history"],
    "stream_sessions": f"SELECT conv_id, request_id AS seq, request_id AS as_of, history_tokens, first_seq, n_messages, summary, compactions, false AS late FROM ({SESSION_SQL['compact_sessions']})",
}
