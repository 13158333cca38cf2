"""Queries over sources, sinks, schemas, guards and small helpers, each read back whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import arrays as A
from quillmesh.functions import equation as EQ
from quillmesh.functions import numeric as N
from quillmesh.functions import policies as P
from quillmesh.functions import text as X
from quillmesh.operators import cards as C
from quillmesh.operators import explain as EX
from quillmesh.operators import gates as G
from quillmesh.operators import graph as GR
from quillmesh.operators import ml
from quillmesh.operators import schemas as SC
from quillmesh.operators import spans as S
from quillmesh.plans.model_queries import register, scratch
from quillmesh.plans.name_queries import greedy
from quillmesh.plans.registry import clean, micro, query, sql_list, table
from quillmesh.sources import readers, writers


def pick(*values, by: str = "doc_id"):
    """The values in turn, by an id."""
    return F.element_at(F.array(*[v if not isinstance(v, (str, int, float)) else F.lit(v) for v in values]), (F.col(by) % len(values) + 1).cast("int"))


def strings(*values: str):
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


@register("q_packed_csv", "SELECT doc_id::VARCHAR AS doc_id, trim(lang) AS lang, trim(source) AS source FROM documents")
def packed_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "packed")
    table(spark, sf_dir, "documents").select("doc_id", "lang", "source").write.option("header", True).option("compression", "gzip").csv(path)
    return readers.read_packed_csv(spark, f"{path}/part-*", "full.csv", ("doc_id", "lang", "source"))


@register("q_source_tiers", "SELECT doc_id, lang FROM documents")
def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "broken")
    spark.range(1).select(F.lit("no table").alias("value")).write.text(path)
    lazy = lambda: spark.read.schema("doc_id bigint, lang string").parquet(path)  # noqa: E731  (fails when it is read, not when it is planned)
    return readers.first_of([lambda: spark.read.parquet(f"{path}/none"), lazy, lambda: table(spark, sf_dir, "documents").select("doc_id", "lang")])


@register("q_existing_path", "SELECT count(*) AS n FROM nation")
def existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(readers.existing(spark, [f"{sf_dir}/none.parquet", f"{sf_dir}/nation.parquet"])).agg(F.count("*").alias("n"))


@query("q_canonical_corpus", f"SELECT 'demo' AS dataset, 'xx' AS lang, {clean()} AS text, 1 - quality::BIGINT AS label FROM documents JOIN labels USING (doc_id) WHERE length({clean()}) > 10 AND quality IS NOT NULL")
def corpus(t):
    raw = t("documents").join(t("labels"), "doc_id").select(F.col("text").alias("article"), F.col("quality").alias("target"))
    return readers.canonical_corpus(raw, "demo", "xx", flip=True)


@register("q_holdout_csv", "SELECT doc_id::VARCHAR AS doc_id, CASE doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS label FROM documents")
def holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "holdout")
    writers.write_csv(table(spark, sf_dir, "documents").select("doc_id", pick(" Real", "FAKE", "both").alias("true_label"), "lang"), path)
    return readers.read_holdout(spark, path).select("doc_id", "label")


@register("q_term_list", "SELECT term, row_number() OVER (ORDER BY length(term) DESC, term) AS place FROM (SELECT DISTINCT lower(trim(n_name)) AS term FROM nation UNION SELECT 'extra term')")
def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "terms")
    writers.write_terms(table(spark, sf_dir, "nation").select("n_name"), "n_name", ["generated", "by hand"], path)
    return spark.createDataFrame([(x, k + 1) for k, x in enumerate(readers.read_terms(spark, path, extra=["Extra term"]))], "term string, place bigint")


@query("q_allowed_terms", "SELECT lower(n_name) AS term FROM nation UNION SELECT 'alias ' || n_regionkey FROM nation UNION SELECT unnest(['candidate a', 'candidate b', 'candidate c'])")
def allowed(t):
    profiles = t("nation").select(F.col("n_name").alias("display_name"), F.array(F.concat(F.lit(" Alias  "), F.col("n_regionkey").cast("string"))).alias("aliases"))
    return readers.allowed_terms(profiles)


@register("q_run_history", "SELECT n_nationkey::BIGINT AS step, n_regionkey::DOUBLE AS epoch, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey / 4.0::DOUBLE END AS loss FROM nation WHERE n_nationkey % 2 = 0 OR n_nationkey % 3 = 0")
def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "history")
    key = F.col("n_nationkey")
    entry = F.struct(key.alias("step"), F.col("n_regionkey").alias("epoch"), F.when(key % 2 == 0, key / 4).alias("loss"), F.when(key % 3 == 0, F.lit(0.5)).alias("eval_loss"))
    runs = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list(entry).alias("log_history"))  # a run, and so a file, for each region
    runs.select(F.to_json(F.struct("log_history")).alias("value"), F.col("n_regionkey").alias("run")).write.partitionBy("run").text(path)
    return readers.read_history(spark, path).select("step", "epoch", "loss")


@query("q_checkpoint_step", "SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN doc_id END AS step FROM documents")
def checkpoint(t):
    i = F.col("doc_id").cast("string")
    return t("documents").select("doc_id", readers.checkpoint_step(pick(F.concat(F.lit("runs/checkpoint-"), i), F.concat(F.lit("checkpoint-"), i, F.lit("/")), F.lit("best"))).alias("step"))


@register("q_lines", "SELECT doc_id::VARCHAR AS value FROM documents WHERE doc_id % 4 <> 0")
def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "lines")
    table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 4 == 0, F.lit("  ")).otherwise(F.col("doc_id").cast("string")).alias("value")).write.text(path)
    return readers.read_lines(spark, path)


@register("q_config", "SELECT 8 AS batch, 0.5::DOUBLE AS rate, true AS quick, '13,47' AS seeds, 'kept' AS name, 'a,b' AS users, '0.6,0.8' AS cuts, 'out/task/run_3/seed_13' AS path")
def config(spark: SparkSession, sf_dir: str) -> DataFrame:
    env = {"QM_BATCH": "8", "QM_RATE": "0.5", "QM_QUICK": "yes", "QM_SEEDS": "13,47", "QM_BAD": "x"}
    c = readers.config({"batch": 4, "rate": 0.1, "quick": False, "seeds": [1], "bad": 1, "name": "kept"}, env)
    row = (c["batch"], c["rate"], c["quick"], ",".join(map(str, c["seeds"])), c["name"], ",".join(readers.expand_users(" a, b,a")), ",".join(map(str, readers.number_list("0.6, 0.8", 2))), readers.run_path("out/", "task", 3, 13))
    return spark.createDataFrame([row], "batch bigint, rate double, quick boolean, seeds string, name string, users string, cuts string, path string")


@query("q_lookup", "SELECT doc_id, CASE lang WHEN 'en' THEN 64 WHEN 'fr' THEN 32 ELSE 8 END AS batch FROM documents")
def lookup(t):
    return t("documents").select("doc_id", P.lookup(F.col("lang"), {"en": 64, "fr": 32}, 8).cast("bigint").alias("batch"))


@register("q_corpus_sink", "SELECT replace(trim(regexp_replace(coalesce(text, ''), '[\\r\\n]+', ' ', 'g')), chr(0), '') AS value, 2 AS tokens FROM documents WHERE trim(regexp_replace(coalesce(text, ''), '[\\r\\n]+', ' ', 'g')) <> ''")
def corpus_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "corpus")
    writers.write_corpus(table(spark, sf_dir, "documents").select(X.conditioned_line([], F.col("text")).alias("line")), "line", ["<|b=1|>", "<|a=1|>", "<|b=1|>"], path)
    manifest = readers.read_jsonl(spark, f"{path}/tokens", "special_tokens array<string>")[0].select(F.size("special_tokens").cast("bigint").alias("tokens"))
    return readers.read_lines(spark, f"{path}/corpus").crossJoin(F.broadcast(manifest))  # one row


@register("q_array_round_trip", f"SELECT vec_id, {micro('list_sum(list_transform(embedding, lambda x: x::DOUBLE))')} AS total, len(embedding) AS n FROM embeddings")
def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "arrays")
    writers.write_arrays(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), path)
    return spark.read.parquet(path).select("vec_id", N.micro(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)).alias("total"), F.size("embedding").cast("bigint").alias("n"))


@register("q_report_sink", "SELECT count(*) AS n, count(DISTINCT lang) AS langs, NULL::VARCHAR AS note FROM documents")
def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "report")
    writers.write_report(table(spark, sf_dir, "documents").agg(F.count("*").alias("n"), F.count_distinct("lang").alias("langs"), F.lit(None).cast("string").alias("note")), path)
    return readers.read_jsonl(spark, path, "n bigint, langs bigint, note string")[0]


@register("q_fan_out", "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "fan")
    writers.write_fan_out(table(spark, sf_dir, "events").select("event_type", "event_id"), "event_type", path)
    return spark.read.json(path).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@register("q_rejects_sink", "SELECT doc_id % 3 = 0 AS accepted, count(*) AS n FROM documents GROUP BY 1")
def rejects_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "rejects")
    good, bad = G.two_way(table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id") % 3 == 0)
    writers.write_with_rejects(good, bad, path)
    read = lambda name, ok: spark.read.json(f"{path}/{name}").select(F.lit(ok).alias("accepted"))
    return read("accepted", True).unionByName(read("rejected", False)).groupBy("accepted").agg(F.count("*").alias("n"))


@register("q_json_schema", "SELECT column_name AS name FROM (DESCRIBE documents)")
def schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = writers.json_schema(table(spark, sf_dir, "documents"))
    return spark.createDataFrame([(text,)], "s string").select(F.explode(F.from_json("s", "struct<fields:array<struct<name:string>>>")["fields"]["name"]).alias("name"))


@register("q_column_names", "SELECT column_name AS raw, CASE WHEN regexp_matches(column_name, '^[0-9]') THEN 'f' ELSE '' END || regexp_replace(column_name, '[^A-Za-z0-9]', '', 'g') AS name FROM (SELECT column_name FROM (DESCRIBE lineitem) UNION ALL SELECT '2 nd_col')")
def column_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = [*readers.require_columns(table(spark, sf_dir, "lineitem"), ["l_orderkey"]).columns, "2 nd_col"]
    return spark.createDataFrame([(c, X.column_name(c)) for c in raw], "raw string, name string")


@query("q_stamp", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'one,two' ELSE 'two' END AS chain, true AS stamped FROM documents")
def stamp(t):
    chain = F.when(F.col("doc_id") % 2 == 0, strings("one"))
    rows = t("documents").select("doc_id", F.struct(chain.alias("script_chain"), F.lit(1).alias("seed")).alias("p"))
    return C.stamp(rows, "p", "two").select("doc_id", F.array_join("p.script_chain", ",").alias("chain"), F.col("p.generated_at").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T").alias("stamped"))


@query("q_split_metrics", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id / 2.0::DOUBLE ELSE 1.0::DOUBLE END AS f1, CASE WHEN doc_id % 3 = 0 THEN 0.25::DOUBLE END AS loss, 1 AS kept FROM documents")
def split_metrics(t):
    number = (F.col("doc_id") / 2).cast("string")
    test = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("test"), F.create_map(F.lit("f1"), number, F.lit("note"), F.lit("none"))))
    test = test.otherwise(F.create_map(F.lit("test_metrics"), F.create_map(F.lit("eval_f1"), F.lit("1.0"))))
    val = F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("eval_metrics"), F.create_map(F.lit("eval_loss"), F.lit("0.25")))).otherwise(F.map_filter(test, lambda k, v: F.lit(False)))
    m = t("documents").select("doc_id", A.split_metrics(F.map_concat(test, val)).alias("m"))
    return m.select("doc_id", F.col("m.test")["f1"].alias("f1"), F.try_element_at("m.val", F.lit("loss")).alias("loss"), F.size("m.test").cast("bigint").alias("kept"))


@query("q_details", "SELECT doc_id, unnest(['EMO', 'URG']) AS code, unnest([doc_id % 2 = 1, false]) AS fired, unnest([(doc_id % 7) / 10.0::DOUBLE, 0.0::DOUBLE]) AS score FROM documents")
def details(t):
    features = F.create_map(F.lit("ind_emo_fired"), (F.col("doc_id") % 2).cast("double"), F.lit("ind_emo_score"), (F.col("doc_id") % 7) / F.lit(10.0))
    return t("documents").select("doc_id", F.explode(A.details(["EMO", "URG"], features)).alias("code", "d")).select("doc_id", "code", "d.fired", "d.score")


@query("q_skip_generator", "SELECT doc_id, doc_id % 4 = 1 AS passed FROM documents")
def skip(t):
    rewrite, passed = G.without_generator(t("documents").select("doc_id", pick(F.lit("model_a"), F.lit("template_v2"), F.lit(None).cast("string"), F.lit("a_template_")).alias("g")), "g")
    return rewrite.select("doc_id", F.lit(False).alias("passed")).unionByName(passed.select("doc_id", F.lit(True).alias("passed")))


@query("q_guard_rows", "SELECT doc_id, (SELECT count(*) FROM documents) AS n FROM documents")
def guard(t):
    docs = t("documents").select("doc_id")
    return G.guard_rows(docs, 1 << 60).crossJoin(F.broadcast(docs.agg(F.count("*").alias("n"))))  # one row


@query("q_tier_by_position", "SELECT doc_id, CASE WHEN doc_id < 10 THEN 'novice' WHEN doc_id < 25 THEN 'proficient' ELSE 'advanced' END AS plain, CASE WHEN doc_id < floor(1000 * 0.40) THEN 'novice' WHEN doc_id < floor(1000 * 0.75) THEN 'proficient' ELSE 'advanced' END AS share FROM documents")
def tier_by_position(t):
    i = F.col("doc_id")
    return t("documents").select("doc_id", P.tier_by_position(i).alias("plain"), P.tier_by_position(i, F.lit(1000)).alias("share"))


SPAN = "struct<start:int,end:int,entity:string>"


def four_spans():
    span = lambda a, n: F.struct(a.cast("int").alias("start"), (a + n).cast("int").alias("end"), F.lit("x").alias("entity"))
    i = F.col("doc_id")
    return F.array(span(i % 7, 3), span(i % 5, 5), span(i % 11 + 2, 2), span(i % 3 + 4, 6))


SPANS = "spans AS (SELECT doc_id, unnest([doc_id % 7, doc_id % 5, doc_id % 11 + 2, doc_id % 3 + 4]) AS start, unnest([doc_id % 7 + 3, doc_id % 5 + 5, doc_id % 11 + 4, doc_id % 3 + 10]) AS \"end\" FROM documents)"


@query("q_greedy_spans", f'WITH RECURSIVE {SPANS}, {greedy("spans", "chosen")} SELECT doc_id, start, "end" FROM chosen')
def greedy_spans(t):
    return t("documents").select("doc_id", F.explode(S.leftmost_longest(four_spans())).alias("s")).select("doc_id", "s.start", "s.end")


@query("q_span_overlap", f'WITH {SPANS} SELECT doc_id, start, "end", NOT ("end" <= 2 OR start >= 5) AS hit FROM spans')
def span_overlap(t):
    other = F.array(F.struct(F.lit(2).alias("start"), F.lit(5).alias("end"), F.lit("y").alias("entity")))
    return t("documents").select("doc_id", F.explode(four_spans()).alias("s")).select("doc_id", "s.start", "s.end", S.overlaps(F.col("s"), other).alias("hit"))


@query("q_collapse_repeats", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'So Ana Cruz met Cruz, Cruz and Anacruz ' || doc_id WHEN 1 THEN 'Ana Cruz' ELSE 'nobody ' || doc_id END AS text FROM documents")
def collapse(t):
    i = F.col("doc_id").cast("string")
    text = pick(F.concat(F.lit("So Ana Cruz met ANA CRUZ, Ana Cruz and Anacruz "), i), F.lit("Ana Cruz"), F.concat(F.lit("nobody "), i))
    return t("documents").select("doc_id", S.collapse_repeats(text, "Ana Cruz", "Cruz").alias("text"))


@query("q_predict_batches", f"SELECT vec_id, {micro('list_sum(list_transform(embedding, lambda x: x::DOUBLE)) * 2')} AS p FROM embeddings")
def predict_batches(t):
    def make():
        return lambda rows: rows.sum(axis=1) * 2

    rows = t("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return ml.predict_batches(rows, make, ["v"], "p", shapes=[[64]]).select("vec_id", N.micro(F.col("p")).alias("p"))


ENCODED = f"""WITH n AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings),
    x AS (SELECT *, coalesce(lag(a) OVER w, 0) AS pa, coalesce(lag(b) OVER w, 0) AS pb FROM n WINDOW w AS (ORDER BY vec_id)),
    h AS (SELECT vec_id, greatest(a + 0.5 * pa + 0.1, 0) AS a, greatest(b - pb, 0) AS b FROM x),
    y AS (SELECT *, coalesce(lag(a) OVER w, 0) AS pa, coalesce(lag(b) OVER w, 0) AS pb FROM h WINDOW w AS (ORDER BY vec_id)),
    g AS (SELECT vec_id, greatest(a + b + pa, 0) AS a, greatest(b + 2 * pb, 0) AS b FROM y)
  SELECT vec_id, {micro('exp(3 * a) / (exp(3 * a) + exp(2 * b - 0.2))')} AS p FROM g"""


@query("q_graph_classes", ENCODED)
def graph_classes(t):
    nodes = t("embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double")).alias("v"))
    edges = t("embeddings").select((F.col("vec_id") - 1).alias("src"), F.col("vec_id").alias("dst")).filter("src >= 0")
    layers = [([[1, 0], [0, 1]], [[0.5, 0], [0, -1]], [0.1, 0]), ([[1, 1], [0, 1]], [[1, 0], [0, 2]], [0, 0])]
    return GR.classify(nodes, edges, "vec_id", "v", layers, ([[3, 0], [0, 2]], [0, -0.2])).select("vec_id", N.micro(F.col("p")[0]).alias("p"))


@query("q_justifying_phrase", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'first' WHEN 1 THEN 'good' ELSE 'summary' END AS phrase FROM documents")
def justifying(t):
    phrase = lambda code, text: F.struct(F.lit(code).alias("indicator"), F.lit(text).alias("phrase"))
    verdict, some = pick("FAKE", "REAL", "REAL"), F.array(phrase("CREDIBLE", "good"), phrase("EMO", "first"))
    own = F.when(F.col("doc_id") % 3 < 2, some).otherwise(F.array(phrase("EMO", "first")))
    return t("documents").select("doc_id", EX.justifying_phrase(verdict, own, F.lit("summary")).alias("phrase"))


@query("q_registry_checks", "SELECT unnest(['unique_codes', 'archetypes', 'names', 'code_format']) AS \"check\", unnest([true, true, true, false]) AS ok")
def registry_checks(t):
    registry = t("region").select(F.when(F.col("r_regionkey") == 0, "bad").otherwise(F.concat(F.lit("C-"), F.upper(F.substring("r_name", 1, 2)))).alias("code"), F.col("r_name").alias("archetype"), F.col("r_name").alias("display_name"))
    return C.assert_registry(registry, n=5)


@register("q_equation_variables", "SELECT unnest(['a', 'bcd', 'x9']) AS name")
def equation_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v in EQ.variables("logreg(0.5*x9 + exp(a) - bcd*a)")], "name string")


@query(
    "q_template_summary",
    f"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'This post looks suspicious' WHEN 1 THEN 'This post appears credible' ELSE 'This post is uncertain' END
      || CASE WHEN doc_id % 2 = 0 THEN '. 2 misinformation cue(s) fired: EMO, ZZZ.' ELSE '. No major misinformation cues fired.' END AS summary, {sql_list(EX.TEMPLATE_PHRASES.values())}[(doc_id % 12 + 1)::INT] AS phrase, 'ZZZ cue detected.' AS other FROM documents""",
)
def template_summary(t):
    fired = F.when(F.col("doc_id") % 2 == 0, strings("EMO", "ZZZ")).otherwise(strings())
    return t("documents").select("doc_id", EX.template_summary(pick("FAKE", "REAL", "UNCERTAIN"), fired).alias("summary"), EX.template_phrase(pick(*EX.TEMPLATE_PHRASES)).alias("phrase"), EX.template_phrase(F.lit("ZZZ")).alias("other"))


@query("q_retry_until", "SELECT doc_id, (SELECT 1 + (count(*) FILTER (doc_id % 4 = 0) < count(*) * 0.4)::INT + (count(*) FILTER (doc_id % 4 < 2) < count(*) * 0.4)::INT FROM documents) AS attempts FROM documents WHERE doc_id % 4 < 2")
def retry(t):
    docs = t("documents").select("doc_id")
    rows, n = G.retry_until(lambda k: docs.filter(F.col("doc_id") % 4 == k), int(docs.count() * 0.4))
    return rows.select("doc_id", F.lit(n).alias("attempts"))


@query(
    "q_model_violations",
    """SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 6 = 5 THEN 'extra_forbidden_field' END, CASE WHEN doc_id % 4 = 0 THEN 'missing_required_field:summary' END,
        CASE WHEN doc_id % 3 = 0 THEN 'not_a_choice:tier' END, CASE WHEN doc_id % 4 = 1 THEN 'length:summary' END) AS explanation,
      concat_ws(',', CASE WHEN doc_id % 5 = 0 THEN 'out_of_range:age' END, CASE WHEN doc_id % 7 < 3 THEN 'items:policy_planks' END) AS profile,
      CASE WHEN doc_id % 20 NOT BETWEEN 1 AND 14 THEN 'out_of_range:day' ELSE '' END AS story FROM documents""",
)
def model_violations(t):
    i = F.col("doc_id")
    explanation = {"tier": F.when(i % 3 == 0, "expert").otherwise("novice"), "summary": F.when(i % 4 == 1, "short").when(i % 4 > 1, "a summary of some length")}
    json = F.when(i % 6 == 5, F.lit('{"tier": "x", "more": 1}')).otherwise(F.lit('{"tier": "x", "summary": "y"}'))
    given = {c: F.lit("x") for c in ("name", "bio", "region", "party_acronym", "party_name", "platform_slogan", "indicator_susceptibility")}
    profile = given | {
        "code": F.lit("C-A1"), "archetype": F.lit("POPULIST"), "age": F.when(i % 5 == 0, 20).otherwise(50), "policy_planks": F.array_repeat(F.lit("p"), (i % 7).cast("int")), "counter_narrative_anchors": strings("a", "b"),
    }
    listed = lambda c: F.array_join(c, ",")
    order = lambda c: F.concat_ws(",", *[F.when(F.array_contains(c, v), v) for v in ("extra_forbidden_field", "missing_required_field:summary", "not_a_choice:tier", "length:summary")])
    return t("documents").select(
        "doc_id", order(SC.broken_rules("ExplanationBlock", explanation, json)).alias("explanation"), listed(SC.broken_rules("CandidateProfile", profile)).alias("profile"),
        listed(SC.broken_rules("StoryCard", {"day": i % 20})).alias("story"),
    )
