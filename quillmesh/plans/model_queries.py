"""Queries over model-backed stages, file round trips and streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import numeric as N
from quillmesh.functions.equation import compile_equation
from quillmesh.operators import ml
from quillmesh.plans.gate_queries import NEGATIVE, POSITIVE, REGISTRY, STAGE_SQL, gated_sql
from quillmesh.operators.ranking import curate
from quillmesh.plans.rank_queries import CARDS, cards, sha
from quillmesh.plans.registry import ORACLES, QUERIES, query, table, whole
from quillmesh.sources import readers, writers
from quillmesh.streaming import gates


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh folder in the place that the cluster shares; a local session gets a temporary one."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if base is None:
        base = f"file://{tempfile.mkdtemp(prefix='quillmesh-')}" if sc.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


# All components: the length of a centred vector does not change under the projection.
@query(
    "q_pca",
    """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings), m AS (SELECT k, avg(x) AS m FROM e WHERE vec_id % 5 <> 0 GROUP BY 1)
      SELECT vec_id, round(sum((x - m) * (x - m)) * 1000000)::BIGINT AS squared, 64 AS components FROM e JOIN m USING (k) GROUP BY 1""",
)
def pca(t):
    vectors = t("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    out = ml.pca(vectors, "v", 64, vectors.filter("vec_id % 5 <> 0"))
    squared = F.aggregate("pca", F.lit(0.0), lambda a, x: a + x * x)
    return out.select("vec_id", N.micro(squared).alias("squared"), F.size("pca").alias("components"))


# A forest over all components finds the rule that labels the rows, away from its border.
@query("q_forest", "SELECT vec_id, (embedding[1] > 0)::BIGINT AS prediction FROM embeddings WHERE abs(embedding[1]) > 0.1")
def forest(t):
    rows = t("embeddings").select("vec_id", (F.element_at("embedding", 1) > 0).cast("double").alias("y"), *[F.element_at("embedding", i + 1).cast("double").alias(f"x{i}") for i in range(64)])
    model, _ = ml.forest(rows, [f"x{i}" for i in range(64)], "y", trees=60)
    return ml.predict_class(model, rows.filter("abs(x0) > 0.1"), ["vec_id"]).select("vec_id", "prediction")


# The baseline tells the language of rows that it was not trained on, but for the very short ones.
@query("q_text_baseline", "SELECT doc_id, (lang = 'en')::BIGINT AS prediction FROM documents WHERE doc_id % 5 = 0 AND length(text) > 200 AND lang IS NOT NULL")
def text_baseline(t):
    rows = t("documents").filter("lang IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.col("lang") == "en").cast("double").alias("y"))
    model = ml.text_baseline(rows.filter("doc_id % 5 <> 0"), "text", "y")
    return ml.predict_class(model, rows.filter("doc_id % 5 = 0 AND length(text) > 200"), ["doc_id"]).select("doc_id", "prediction")


# Where a logistic regression fits, predictions and labels have the same moments.
@query(
    "q_linear_equation",
    """SELECT moment, round(value * 100)::BIGINT AS hundredths FROM (SELECT avg(y) AS one, avg(y * l_quantity) AS quantity, avg(y * l_discount) AS discount
      FROM (SELECT (l_returnflag = 'R')::INT::DOUBLE AS y, l_quantity::DOUBLE AS l_quantity, l_discount::DOUBLE AS l_discount FROM lineitem)) UNPIVOT (value FOR moment IN (one, quantity, discount))""",
)
def linear_equation(t):
    rows = t("lineitem").select(F.col("l_quantity").cast("double").alias("l_quantity"), F.col("l_discount").cast("double").alias("l_discount"), (F.col("l_returnflag") == "R").cast("double").alias("y"))
    text = ml.linear_equation(rows, ["l_quantity", "l_discount"], "y")
    p = compile_equation(text, rows.columns)
    one = rows.select(p.alias("p"), "l_quantity", "l_discount").agg(F.avg("p").alias("one"), F.avg(F.col("p") * F.col("l_quantity")).alias("quantity"), F.avg(F.col("p") * F.col("l_discount")).alias("discount"))
    return one.unpivot([], ["one", "quantity", "discount"], "moment", "value").select("moment", F.round(F.col("value") * 100).cast("bigint").alias("hundredths"))


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: whole(fn(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@register("q_model_round_trip", "SELECT vec_id, (embedding[1] > 0)::BIGINT AS prediction FROM embeddings WHERE abs(embedding[1]) > 0.1")
def model_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "model")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", (F.element_at("embedding", 1) > 0).cast("double").alias("y"), *[F.element_at("embedding", i + 1).cast("double").alias(f"x{i}") for i in range(4)])
    ml.save_model(ml.forest(rows, [f"x{i}" for i in range(4)], "y", trees=10)[0], path)
    return ml.predict_class(ml.load_model(path), rows.filter("abs(x0) > 0.1"), ["vec_id"]).select("vec_id", "prediction")


@register("q_jsonl_round_trip", "SELECT conv_id, turn, role, text FROM conversations")
def jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "jsonl")
    writers.write_jsonl(table(spark, sf_dir, "conversations"), path)
    return readers.read_jsonl(spark, path, "conv_id bigint, turn bigint, role string, text string")[0]


@register("q_reject_malformed", "SELECT event_type AS reason, count(*) AS n FROM (SELECT CASE WHEN event_id % 10 = 3 THEN 'malformed_json' ELSE 'ok' END AS event_type FROM events) GROUP BY 1")
def malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "mixed")
    lines = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 10 == 3, F.lit('{"k": ')).otherwise(F.col("props")).alias("value"))
    lines.write.text(path)
    good, bad = readers.read_jsonl(spark, path, "k bigint")
    return good.select(F.lit("ok").alias("reason")).unionByName(bad.select("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@register("q_csv_round_trip", "SELECT doc_id::VARCHAR AS doc_id, trim(text) AS text FROM documents")
def csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "csv")
    writers.write_csv(table(spark, sf_dir, "documents").select("doc_id", F.trim("text").alias("text")), path)
    return readers.read_csv(spark, path).select("doc_id", "text")


# A pool is a report of a curated size: so many cards, with a reserve of REAL and a cap on UNCERTAIN.
POOL = 700
N_REAL, N_OPEN = int(POOL * 0.35), int(POOL * 0.10)


@register(
    "q_pool_document",
    f"""WITH cards AS (SELECT *, {sha(1729)} AS h0, row_number() OVER (PARTITION BY verdict ORDER BY {sha(1729)}, doc_id) AS r0, count(*) FILTER (verdict = 'REAL') OVER () AS nr, count(*) FILTER (verdict = 'UNCERTAIN') OVER () AS nu FROM {CARDS})
      SELECT id, lang, text, '{{"version":"1"}}' AS meta FROM cards ORDER BY CASE WHEN verdict = 'REAL' AND r0 <= {N_REAL} THEN 1 WHEN verdict = 'UNCERTAIN' AND r0 <= {N_OPEN} THEN 2 WHEN verdict = 'FAKE' AND r0 <= {POOL} - least(nr, {N_REAL}) - least(nu, {N_OPEN}) THEN 3 ELSE 4 END, h0, doc_id LIMIT {POOL}""",
)
def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "pool")
    chosen = curate(cards(lambda name: table(spark, sf_dir, name)), "doc_id", POOL).select("id", "lang", "text")
    writers.write_pool(chosen, {"version": "1"}, path)
    return readers.read_pool(spark, path, "struct<id:string,lang:string,text:string>").select("id", "lang", "text", F.regexp_replace("pool_metadata", " ", "").alias("meta"))


@register(
    "q_stream_gates",
    f"""WITH g AS ({gated_sql('documents', mention=False)}) SELECT doc_id, 'accepted' AS stage FROM g WHERE len(reasons) = 0
      UNION ALL SELECT doc_id, {STAGE_SQL} AS stage FROM (SELECT doc_id, unnest(reasons) AS reason FROM g)""",
)
def stream_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "stream")
    docs = table(spark, sf_dir, "documents")
    stream = gates.read_stream(spark, f"{sf_dir}/documents.parquet", docs.schema)
    gates.gate_stream(stream, "doc_id", "text", REGISTRY, out, f"{out}/checkpoint", positive=POSITIVE, negative=NEGATIVE, require_mention=False).awaitTermination()
    accepted = spark.read.parquet(f"{out}/accepted").select("doc_id", F.lit("accepted").alias("stage"))
    return accepted.unionByName(spark.read.parquet(f"{out}/rejected").select("doc_id", "stage"))


@register("q_stream_counts", "SELECT strftime(ts, '%Y-%m-%d') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "counts")
    events = table(spark, sf_dir, "events")
    stream = gates.read_stream(spark, f"{sf_dir}/events.parquet", events.schema).withColumn("ts", F.col("ts").cast("timestamp"))
    counted = gates.counts_stream(stream, "ts", ["event_type"], late="60 days")
    gates.run_to_end(counted, f"{out}/checkpoint", lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/latest"), "complete")
    return spark.read.parquet(f"{out}/latest").select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n")


@register(
    "q_html_cards",
    """SELECT doc_id, '<section><h2>' || doc_id || '</h2><p>' || replace(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '</p><dl><dt>lang</dt><dd>' || lang || '</dd></dl></section>' AS html FROM documents""",
)
def html_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return writers.html_cards(docs, "doc_id", F.col("doc_id").cast("string"), F.col("text"), {"lang": F.col("lang")})


@register("q_markdown_rows", r"SELECT doc_id, '| ' || doc_id || ' | ' || lang || ' | ' || replace(coalesce(text, ''), '|', '\|') || ' |' AS line FROM documents")
def markdown_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.markdown_rows(table(spark, sf_dir, "documents"), "doc_id", ["doc_id", "lang", "text"])


@register("q_page_hosts", "SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, count(*) AS n FROM pages GROUP BY 1")
def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host")).agg(F.count("*").alias("n"))
