"""Queries over de-duplication, quotas, samples, joins, reports, graphs, spans and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions import equation as EQ
from quillmesh.functions import hashing as H
from quillmesh.functions import numeric as N
from quillmesh.functions import policies as P
from quillmesh.functions import text as X
from quillmesh.operators import explain as EX
from quillmesh.operators import graph as GR
from quillmesh.operators import ranking as K
from quillmesh.operators import reports as R
from quillmesh.operators import spans as S
from quillmesh.plans.registry import CANDIDATE, P_FAKE, clean, micro, query
from quillmesh.plans.text_queries import candidate, p_fake

VERDICT = f"CASE WHEN {P_FAKE} >= 0.6::DOUBLE THEN 'FAKE' WHEN {P_FAKE} <= 0.4::DOUBLE THEN 'REAL' ELSE 'UNCERTAIN' END"
CARDS = f"(SELECT doc_id, doc_id::VARCHAR AS id, text, source, lang, {VERDICT} AS verdict, {CANDIDATE} AS candidate FROM documents)"


def cards(t):
    return t("documents").select("doc_id", F.col("doc_id").cast("string").alias("id"), "text", "source", "lang", P.verdict(p_fake()).alias("verdict"), candidate().alias("candidate"))


def sha(seed, key: str = "doc_id") -> str:
    return f"sha256('{seed}|' || {key})"


@query("q_dedup_keep_first", f"SELECT doc_id, clean FROM (SELECT doc_id, {clean()} AS clean FROM documents) WHERE length(clean) > 10 QUALIFY row_number() OVER (PARTITION BY clean ORDER BY doc_id) = 1")
def dedup(t):
    rows = t("documents").select("doc_id", X.clean_text(F.col("text")).alias("clean")).filter(F.length("clean") > 10)
    return K.keep_first(rows, ["clean"], [F.col("doc_id")])


@query("q_surrogate_id", f"SELECT doc_id, 'docs_' || (row_number() OVER (ORDER BY doc_id) - 1) AS surrogate FROM (SELECT doc_id FROM (SELECT doc_id, {clean()} AS clean FROM documents) QUALIFY row_number() OVER (PARTITION BY clean ORDER BY doc_id) = 1)")
def surrogate(t):
    rows = t("documents").select("doc_id", X.clean_text(F.col("text")).alias("clean"))
    kept = K.keep_first(rows, ["clean"], [F.col("doc_id")]).select("doc_id")
    return K.rank_by_id(kept, "doc_id").select("doc_id", F.concat(F.lit("docs_"), F.col("position").cast("string")).alias("surrogate"))


@query("q_hash_position", f"SELECT doc_id, row_number() OVER (ORDER BY {sha(7)}, doc_id) - 1 AS position FROM documents")
def hash_position(t):
    return K.rank_by_hash(t("documents").select("doc_id"), 7, "doc_id")


SPLIT = f"""(SELECT doc_id, lang, CASE WHEN r < floor(n * 0.7::DOUBLE) THEN 'train' WHEN r < floor(n * 0.85::DOUBLE) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {sha(42)}, doc_id) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents))"""


@query("q_stratified_split", f"SELECT doc_id, split FROM {SPLIT}")
def split(t):
    return K.split(t("documents").select("doc_id", "lang"), "doc_id", "lang").select("doc_id", "split")


@query("q_split_balance", f"SELECT lang, split, count(*) AS n FROM {SPLIT} GROUP BY ALL")
def split_balance(t):
    return K.split(t("documents").select("doc_id", "lang"), "doc_id", "lang").groupBy("lang", "split").agg(F.count("*").alias("n"))


@query("q_bucket_quota", f"SELECT doc_id, verdict, candidate, r AS bucket_rank FROM (SELECT *, row_number() OVER (PARTITION BY verdict, candidate ORDER BY {sha(1729)}, doc_id) AS r FROM {CARDS}) WHERE r <= 20")
def bucket_quota(t):
    return K.take_per_group(cards(t), ["verdict", "candidate"], 1729, "doc_id", 20).select("doc_id", "verdict", "candidate", "bucket_rank")


BALANCED = f"""SELECT doc_id, verdict, candidate, ['quota', 'uncertain', 'top_up'][step + 1] AS reason FROM (
  SELECT *, CASE WHEN verdict = 'FAKE' AND r <= 33 OR verdict = 'REAL' AND r <= 28 THEN 0 WHEN verdict = 'UNCERTAIN' AND u <= 15 THEN 1 ELSE 2 END AS step FROM (
    SELECT *, {sha(1729)} AS h, row_number() OVER (PARTITION BY verdict, candidate ORDER BY {sha(1729)}, doc_id) AS r, row_number() OVER (PARTITION BY verdict ORDER BY {sha(1729)}, doc_id) AS u FROM {CARDS}))
  ORDER BY step, h, doc_id LIMIT 200"""


@query("q_balance", BALANCED)
def balance(t):
    return K.balance(cards(t), "doc_id", 200).select("doc_id", "verdict", "candidate", "reason")


@query(
    "q_pool_curate",
    f"""SELECT doc_id, verdict, row_number() OVER (ORDER BY step, h, doc_id) - 1 AS pool_index FROM (
      SELECT *, CASE WHEN verdict = 'REAL' AND r <= 70 THEN 1 WHEN verdict = 'UNCERTAIN' AND r <= 20 THEN 2 WHEN verdict = 'FAKE' AND r <= 200 - least(nr, 70) - least(nu, 20) THEN 3 ELSE 4 END AS step FROM (
        SELECT *, {sha(1729)} AS h, row_number() OVER (PARTITION BY verdict ORDER BY {sha(1729)}, doc_id) AS r, count(*) FILTER (verdict = 'REAL') OVER () AS nr, count(*) FILTER (verdict = 'UNCERTAIN') OVER () AS nu FROM {CARDS}))
      ORDER BY step, h, doc_id LIMIT 200""",
)
def curate(t):
    return K.curate(cards(t), "doc_id", 200).select("doc_id", "verdict", "pool_index")


@query(
    "q_apportion",
    """SELECT o_orderpriority, (f + (row_number() OVER (ORDER BY raw - f DESC, o_orderpriority DESC) <= 30 - sum(f) OVER ())::INT)::BIGINT AS slots
      FROM (SELECT o_orderpriority, raw, floor(raw)::INT AS f FROM (SELECT o_orderpriority, 30 * count(*) / (SELECT count(*) FROM orders)::DOUBLE AS raw FROM orders GROUP BY 1))""",
)
def apportion(t):
    return K.apportion(t("orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")), "o_orderpriority", "n", 30)


@query(
    "q_block_chunk",
    """WITH w AS (SELECT lang, doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}_]+')) AS w, generate_subscripts(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}_]+'), 1) AS k FROM documents),
      p AS (SELECT lang, w, row_number() OVER (PARTITION BY lang ORDER BY doc_id, k) - 1 AS pos FROM w)
      SELECT lang, pos // 256 AS chunk, md5(string_agg(w, ' ' ORDER BY pos)) AS digest FROM p GROUP BY 1, 2 HAVING count(*) = 256""",
)
def block_chunk(t):
    rows = t("documents").select("lang", "doc_id", X.words(F.col("text")).alias("words"))
    chunks = K.chunk(rows, "words", 256, ["lang"], ["doc_id"])
    return chunks.select("lang", "chunk", F.md5(F.array_join("tokens", " ").cast("binary")).alias("digest"))


@query("q_best_run", "SELECT o_custkey::BIGINT AS o_custkey, o_orderkey::BIGINT AS o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def best_run(t):
    return K.best_run(t("orders"), ["o_custkey"], ["o_totalprice"], "o_orderkey").select("o_custkey", "o_orderkey")


@query("q_examples", "SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS example FROM documents QUALIFY example <= 10")
def examples(t):
    return R.examples(t("documents").select("lang", "doc_id"), ["lang"], ["doc_id"], 10)


@query(
    "q_last_real_asof",
    "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_user FROM conversations",
)
def last_real(t):
    return K.last_before(t("conversations"), ["conv_id"], ["turn"], F.col("role") == "user", F.col("turn"), "last_user").select("conv_id", "turn", "last_user")


# Words of ASCII letters between blanks, which both engines see alike in any language.
@query(
    "q_first_appearance",
    """WITH w AS (SELECT doc_id, unnest(string_split(replace(coalesce(text, ''), chr(10), ' '), ' ')) AS w, generate_subscripts(string_split(replace(coalesce(text, ''), chr(10), ' '), ' '), 1) AS k FROM documents)
      SELECT w AS entity, row_number() OVER (ORDER BY min({'a': doc_id, 'b': k})) - 1 AS idx FROM w WHERE regexp_full_match(w, '[A-Z][a-z]{4,5}') GROUP BY 1""",
)
def first_appearance(t):
    words = F.split(F.translate(F.coalesce("text", F.lit("")), "\n", " "), " ", -1)
    rows = t("documents").select("doc_id", F.posexplode(words).alias("k", "entity")).filter(F.col("entity").rlike("^[A-Z][a-z]{4,5}$"))
    return K.first_appearance(rows, "entity", ["doc_id", "k"]).select("entity", F.col("index").alias("idx"))


@query(
    "q_feature_join",
    f"""SELECT d.doc_id, l.quality::BIGINT AS quality, e.label::BIGINT AS label, {micro("CASE WHEN l.quality IS NULL THEN NULL WHEN l.quality = 1 THEN " + P_FAKE.replace('doc_id', 'd.doc_id') + " ELSE 1 - " + P_FAKE.replace('doc_id', 'd.doc_id') + " END")} AS conf
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN embeddings e ON d.doc_id = e.vec_id""",
)
def feature_join(t):
    docs, labels = t("documents").select("doc_id", p_fake().alias("p")), t("labels")
    joined = docs.join(labels, "doc_id", "left").join(t("embeddings").select(F.col("vec_id").alias("doc_id"), "label"), "doc_id", "left")
    return joined.select("doc_id", "quality", "label", N.micro(F.when(F.col("quality").isNotNull(), N.confidence(F.col("p"), F.col("quality")))).alias("conf"))


@query(
    "q_positional_join",
    """SELECT d.doc_id, e.vec_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents) d JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings) e USING (r)""",
)
def positional(t):
    left = K.rank_by_id(t("documents").select("doc_id"), "doc_id")
    right = K.rank_by_id(t("embeddings").select("vec_id"), "vec_id")
    return left.join(right, "position").select("doc_id", "vec_id")


BANK = [(c, tier, f"{c} phrase {k} for {tier}", f"move {k}", f"{c}/v1/{tier[0]}{k}") for c in ("EMO", "URG", "MISS", "CREDIBLE") for tier, n in (("novice", 3), ("advanced", 2)) for k in range(n) if not (c == "MISS" and tier == "advanced")]
BANK_VALUES = "(VALUES " + ", ".join("('" + "', '".join(r) + "')" for r in BANK) + ") AS b(code, tier, phrase, sift, bank_id)"


def bank(df):
    return df.sparkSession.createDataFrame(BANK, "code string, tier string, phrase string, sift string, bank_id string")


TIERED = """SELECT doc_id, ['EMO', 'URG', 'MISS', 'POL'][(doc_id % 4 + 1)::INT] AS code, ['novice', 'advanced'][(doc_id % 2 + 1)::INT] AS tier FROM documents"""


def tiered(t):
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("doc_id") % len(xs) + 1).cast("int"))
    return t("documents").select("doc_id", pick(("EMO", "URG", "MISS", "POL")).alias("code"), pick(("novice", "advanced")).alias("tier"))


@query(
    "q_bank_lookup",
    f"""WITH v AS (SELECT code, tier, list(bank_id ORDER BY bank_id) AS ids FROM {BANK_VALUES} GROUP BY 1, 2),
      j AS (SELECT d.doc_id, d.code, d.tier, coalesce(a.ids, b.ids) AS ids FROM ({TIERED}) d LEFT JOIN v a ON a.code = d.code AND a.tier = d.tier LEFT JOIN v b ON b.code = d.code AND b.tier = 'novice')
      SELECT doc_id, ids[(('0x' || substr(sha256(doc_id || code || tier), 1, 8))::BIGINT % greatest(len(ids), 1) + 1)::INT] AS bank_id FROM j""",
)
def bank_lookup(t):
    rows = tiered(t)
    return EX.with_bank_entry(rows, bank(rows), "code", "tier", F.col("doc_id").cast("string")).select("doc_id", F.col("entry.bank_id").alias("bank_id"))


@query(
    "q_variant_rotation",
    f"""WITH v AS (SELECT code, list(phrase ORDER BY bank_id) AS vs FROM {BANK_VALUES} GROUP BY 1)
      SELECT d.doc_id, vs[(d.doc_id % len(vs) + 1)::INT] AS variant FROM ({TIERED}) d LEFT JOIN v USING (code)""",
)
def rotation(t):
    rows = tiered(t)
    entries = bank(rows).groupBy("code").agg(F.array_sort(F.collect_list(F.struct("bank_id", "phrase"))).alias("v"))
    variants = entries.select("code", F.transform("v", lambda x: x["phrase"]).alias("variants"))
    return EX.variant_rotation(rows, variants, "code", F.col("doc_id")).select("doc_id", "variant")


@query(
    "q_template_cross",
    """SELECT r_regionkey || '' AS template_id, n_name AS candidate, k AS replica, ['first', 'second', 'third'][(('0x' || substr(sha256(r_regionkey || '|' || n_name || '|' || k), 1, 8))::BIGINT % 3 + 1)::INT] AS variant
      FROM region JOIN nation ON n_regionkey = r_regionkey, (SELECT unnest(range(0, 18)) AS k)""",
)
def template_cross(t):
    templates = t("region").select(F.col("r_regionkey").cast("string").alias("template_id"), F.array(F.col("r_regionkey").cast("string")).alias("archetypes"), F.array(F.lit("first"), F.lit("second"), F.lit("third")).alias("variants"))
    people = t("nation").select(F.col("n_regionkey").cast("string").alias("archetype"), F.col("n_name").alias("candidate"))
    return EX.templates_cross(templates, people, 18).select("template_id", "candidate", "replica", "variant")


@query(
    "q_bank_diff",
    """SELECT coalesce(a.p_partkey, b.p_partkey)::BIGINT AS p_partkey, CASE WHEN b.p_partkey IS NULL THEN 'removed' WHEN a.p_partkey IS NULL THEN 'added' ELSE 'changed' END AS change
      FROM (SELECT p_partkey, p_name FROM part WHERE p_partkey % 5 <> 0) a FULL JOIN (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'new' ELSE p_name END AS p_name FROM part WHERE p_partkey % 3 <> 0) b ON a.p_partkey = b.p_partkey
      WHERE a.p_partkey IS NULL OR b.p_partkey IS NULL OR a.p_name IS DISTINCT FROM b.p_name""",
)
def bank_diff(t):
    part = t("part").select("p_partkey", "p_name")
    b = part.filter("p_partkey % 3 <> 0").withColumn("p_name", F.when(F.col("p_partkey") % 7 == 0, "new").otherwise(F.col("p_name")))
    return EX.bank_diff(part.filter("p_partkey % 5 <> 0"), b, "p_partkey", "p_name")


@query("q_bank_coverage_anti", "SELECT DISTINCT l_partkey::BIGINT AS l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def coverage_anti(t):
    keys = t("part").filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey"))
    return t("lineitem").select("l_partkey").distinct().join(keys, "l_partkey", "left_anti")


@query(
    "q_fake_real_pairing",
    f"""WITH r AS (SELECT doc_id AS counter_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM {CARDS} WHERE verdict = 'REAL')
      SELECT f.doc_id, r.counter_id FROM {CARDS} f LEFT JOIN r ON r.pos = ('0x' || substr(sha256('pair' || f.doc_id), 1, 8))::BIGINT % (SELECT count(*) FROM r) WHERE f.verdict = 'FAKE'""",
)
def pairing(t):
    rows = cards(t)
    return EX.pair_with(rows.filter("verdict = 'FAKE'").select("doc_id"), rows.filter("verdict = 'REAL'"), "doc_id", "doc_id", "pair")


@query(
    "q_deck_overlap",
    f"""WITH d AS (SELECT DISTINCT user_id AS u, event_type || '/' || date_part('day', ts) AS i FROM events WHERE user_id IN (SELECT DISTINCT user_id FROM events ORDER BY user_id LIMIT 25)), s AS (SELECT u, count(*) AS n FROM d GROUP BY 1)
      SELECT x.u AS a, y.u AS b, count(*) AS common, {micro('count(*) / least(any_value(p.n), any_value(q.n))')} AS overlap_micro
      FROM d x JOIN d y ON x.i = y.i AND x.u < y.u JOIN s p ON p.u = x.u JOIN s q ON q.u = y.u GROUP BY 1, 2""",
)
def deck_overlap(t):
    # the report is over the decks of the first 25 users
    users = t("events").select("user_id").distinct().orderBy("user_id").limit(25)
    decks = t("events").join(users, "user_id").select("user_id", F.concat_ws("/", "event_type", F.dayofmonth("ts").cast("string")).alias("item"))
    return R.deck_overlap(decks, "user_id", "item")


CONF = "SELECT quality AS t, (doc_id % 3 <> 0)::INT AS p, toxic FROM labels"


@query("q_confusion", "SELECT ['REAL', 'FAKE'][quality + 1] AS gold, count(*) FILTER (doc_id % 3 = 0) AS FAKE, count(*) FILTER (doc_id % 3 = 1) AS REAL, count(*) FILTER (doc_id % 3 = 2) AS UNCERTAIN FROM labels GROUP BY 1")
def confusion(t):
    name = F.element_at(F.array(F.lit("FAKE"), F.lit("REAL"), F.lit("UNCERTAIN")), (F.col("doc_id") % 3 + 1).cast("int"))
    rows = t("labels").select(F.when(F.col("quality") == 1, "FAKE").otherwise("REAL").alias("gold"), name.alias("pred"))
    return R.confusion_matrix(rows, "gold", "pred")


@query(
    "q_binary_metrics",
    f"""SELECT toxic::BIGINT AS toxic, tp, fp, tn, fn, {micro('(tp + tn) / (tp + fp + tn + fn)::DOUBLE')} AS accuracy, {micro('coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0)')} AS "precision", {micro('coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0)')} AS recall
      FROM (SELECT toxic, count(*) FILTER (t = 1 AND p = 1) AS tp, count(*) FILTER (t = 0 AND p = 1) AS fp, count(*) FILTER (t = 0 AND p = 0) AS tn, count(*) FILTER (t = 1 AND p = 0) AS fn FROM ({CONF}) GROUP BY 1)""",
)
def binary_metrics(t):
    m = R.binary_metrics(t("labels"), F.col("quality"), (F.col("doc_id") % 3 != 0).cast("int"), ["toxic"])
    return m.select("toxic", "tp", "fp", "tn", "fn", N.micro(F.col("accuracy")).alias("accuracy"), N.micro(F.col("precision")).alias("precision"), N.micro(F.col("recall")).alias("recall"))


@query("q_per_stratum", f"SELECT coalesce(lang, 'unknown') AS stratum, count(*) AS n, count(*) FILTER (verdict = CASE WHEN doc_id % 2 = 0 THEN 'FAKE' ELSE 'REAL' END) AS correct, {micro("count(*) FILTER (verdict = CASE WHEN doc_id % 2 = 0 THEN 'FAKE' ELSE 'REAL' END) / count(*)")} AS accuracy_micro FROM {CARDS} GROUP BY 1")
def per_stratum(t):
    rows = cards(t).withColumn("gold", F.when(F.col("doc_id") % 2 == 0, "FAKE").otherwise("REAL"))
    return R.stratum_accuracy(rows, "gold", "verdict", F.col("lang"))


@query("q_run_stats", f"SELECT l_returnflag, count(*) AS runs, {micro('avg(l_quantity::DOUBLE)')} AS mean, {micro('stddev_pop(l_quantity::DOUBLE)')} AS std FROM lineitem GROUP BY 1")
def run_stats(t):
    return R.run_stats(t("lineitem"), ["l_returnflag"], F.col("l_quantity").cast("double")).select("l_returnflag", "runs", N.micro(F.col("mean")).alias("mean"), N.micro(F.col("std")).alias("std"))


@query("q_paired_t", f"SELECT count(*) AS n, {micro('avg(d) / (stddev_samp(d) / sqrt(count(*)))')} AS t FROM (SELECT l_discount::DOUBLE - l_tax::DOUBLE AS d FROM lineitem)")
def paired_t(t):
    return R.paired_t(t("lineitem"), F.col("l_discount").cast("double"), F.col("l_tax").cast("double")).select("n", N.micro(F.col("t")).alias("t"))


@query("q_distributions", f"SELECT axis, value, count(*) AS n FROM (SELECT unnest([{{'axis': 'lang', 'value': lang}}, {{'axis': 'source', 'value': source}}, {{'axis': 'verdict', 'value': verdict}}, {{'axis': 'candidate', 'value': candidate}}], recursive := true) FROM {CARDS}) GROUP BY ALL")
def distributions(t):
    return R.distributions(cards(t), ["lang", "source", "verdict", "candidate"])


@query("q_diversity", f"SELECT count(*) AS total, count(DISTINCT text) AS distinct_values, {micro('count(DISTINCT text) / count(*)')} AS diversity_micro FROM documents")
def diversity(t):
    return R.diversity(t("documents"), "text")


@query(
    "q_empirical_rates",
    f"""WITH f AS (SELECT candidate, unnest(codes) AS code FROM (SELECT {CANDIDATE} AS candidate, CASE WHEN doc_id % 4 = 0 THEN ['EMO', 'URG'] WHEN doc_id % 4 = 1 THEN ['URG'] ELSE [] END AS codes FROM documents)),
      g AS (SELECT candidate, count(*) AS total FROM (SELECT {CANDIDATE} AS candidate FROM documents) GROUP BY 1)
      SELECT g.candidate, c.code, count(f.code) AS fired, total, {micro('count(f.code) / total')} AS rate_micro FROM g, (SELECT unnest(['EMO', 'URG', 'MISS']) AS code) c LEFT JOIN f ON f.candidate = g.candidate AND f.code = c.code GROUP BY g.candidate, c.code, total""",
)
def empirical(t):
    codes = F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("EMO"), F.lit("URG"))).when(F.col("doc_id") % 4 == 1, F.array(F.lit("URG"))).otherwise(F.array().cast("array<string>"))
    return R.empirical_rates(t("documents").select(candidate().alias("candidate"), codes.alias("codes")), "candidate", "codes", ["EMO", "URG", "MISS"])


CAP = r"[A-Z][a-z][A-Za-zÀ-ÿ''’-]{1,}"


@query("q_top_names", "SELECT w AS name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]+ [a-z]+')) AS w FROM documents) GROUP BY 1 ORDER BY n DESC, name LIMIT 30")
def top_names(t):
    rows = t("documents").select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Z][a-z]+ [a-z]+"), F.lit(0))).alias("name"))
    return R.top_frequencies(rows, "name", 30)


PLACES = ("the", "of the", "and", "les", "luzon", "der city", "que")
# The oracle's engine has no look-around: every separator is doubled, so that neighbouring matches can each consume one.
DOUBLED = r"regexp_replace(coalesce(text, ''), '([^A-Za-z0-9])', '\1\1', 'g')"
PLACE_RE = "(?i)(^|[^A-Za-z0-9])(" + "|".join(p.replace(" ", "  ") for p in sorted(PLACES, key=lambda x: (-len(x), x))) + ")([^A-Za-z0-9]|$)"
PLACE_CODES = f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all({DOUBLED}, '{PLACE_RE}', 2)) AS m, generate_subscripts(regexp_extract_all({DOUBLED}, '{PLACE_RE}', 2), 1) AS k FROM documents),
    e AS (SELECT lower(replace(m, '  ', ' ')) AS entity, min({{'a': doc_id, 'b': k}}) AS first FROM w GROUP BY 1),
    c AS (SELECT entity, CASE entity WHEN 'luzon' THEN 'island_group' WHEN 'der city' THEN 'city' ELSE 'province' END AS category, first FROM e),
    r AS (SELECT entity, category, row_number() OVER (PARTITION BY category ORDER BY first) - 1 AS idx FROM c)
  SELECT entity, category, idx, CASE category WHEN 'island_group' THEN 'Island Group ' || (idx + 1) WHEN 'city' THEN 'City ' || ['W', 'X', 'Y'][idx + 1] ELSE 'Province ' || ['L', 'M', 'N', 'O', 'P', 'K', 'J', 'I'][idx + 1] END AS pseudonym FROM r"""


@query("q_place_codes", PLACE_CODES)
def place_codes(t):
    return S.place_codes(t("documents"), "doc_id", "text", PLACES).withColumnRenamed("index", "idx")


def _place_text() -> str:
    # each place becomes a mark that no text holds, separators are halved again, and marks give way to pseudonyms
    text = DOUBLED
    order = sorted(PLACES, key=lambda x: (-len(x), x))
    for k, p in enumerate(order):
        text = f"regexp_replace({text}, '(?i)(^|[^A-Za-z0-9]){p.replace(' ', '  ')}([^A-Za-z0-9]|$)', '\\1QZQ{k}QZQ\\2', 'g')"
    text = f"array_to_string(list_transform(regexp_extract_all({text}, '[A-Za-z0-9]+|[^A-Za-z0-9][^A-Za-z0-9]'), lambda x: CASE WHEN regexp_matches(x, '^[A-Za-z0-9]') THEN x ELSE substr(x, 1, 1) END), '')"
    text = text.replace("[^A-Za-z0-9][^A-Za-z0-9]'), lambda", "(?s:[^A-Za-z0-9][^A-Za-z0-9])'), lambda")
    for k, p in enumerate(order):
        text = f"replace({text}, 'QZQ{k}QZQ', coalesce((SELECT pseudonym FROM codes WHERE entity = '{p}'), '{p}'))"
    return text


@query("q_place_pseudonymise", f"WITH codes AS ({PLACE_CODES}) SELECT doc_id, {_place_text()} AS text, len(regexp_extract_all({DOUBLED}, '{PLACE_RE}', 2))::BIGINT AS n_places FROM documents")
def place_text(t):
    return S.pseudonymise_places(t("documents").select("doc_id", "text"), "doc_id", "text", PLACES)


@query(
    "q_schema_violations",
    f"""SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 9 = 0 THEN 'missing_required_field:text' END, CASE WHEN length(doc_id::VARCHAR) < 3 THEN 'id_too_short' END,
        CASE WHEN doc_id % 9 <> 0 AND length(text) NOT BETWEEN 20 AND 2000 THEN 'text_length' END, CASE WHEN doc_id % 9 <> 0 AND length(trim(text)) < 30 THEN 'text_too_short' END,
        CASE WHEN doc_id % 4 = 0 THEN 'invalid_verdict' END, CASE WHEN doc_id % 5 = 0 THEN 'invalid_candidate_code' END, CASE WHEN doc_id % 11 = 10 THEN 'out_of_range:fake_likelihood_percent' END], lambda x: x IS NOT NULL), ',') AS broken FROM documents""",
)
def schema_violations(t):
    i = F.col("doc_id")
    fields = {
        "id": i.cast("string"), "text": F.when(i % 9 != 0, F.col("text")), "verdict": F.when(i % 4 == 0, "MAYBE").otherwise("FAKE"),
        "candidate": F.when(i % 5 == 0, "c-a").otherwise("C-A"), "fake_likelihood_percent": (i % 11 * 10.5),
    }
    return t("documents").select("doc_id", F.array_join(EX.violations(None, fields), ",").alias("broken"))


def explained(t):
    rows = cards(t).withColumn("tier", F.lit("novice"))
    codes = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("URG"), F.lit("EMO"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("POL"))).otherwise(F.array(F.lit("MISS")))
    rows = rows.withColumn("fired", codes)
    return rows, EX.explanation(rows, bank(rows), "doc_id", "fired", "verdict", F.col("doc_id") % 101 + 0.25, "tier")


EXPLAINED = f"""WITH v AS (SELECT code, list({{'id': bank_id, 'phrase': phrase}} ORDER BY bank_id) AS vs FROM {BANK_VALUES} WHERE tier = 'novice' GROUP BY 1),
    c AS (SELECT doc_id, verdict, doc_id % 101 AS k, CASE WHEN verdict = 'REAL' THEN ['CREDIBLE'] WHEN doc_id % 3 = 0 THEN ['EMO', 'URG'] WHEN doc_id % 3 = 1 THEN ['POL'] ELSE ['MISS'] END AS codes FROM {CARDS}),
    e AS (SELECT doc_id, unnest(codes) AS code, generate_subscripts(codes, 1) AS pos FROM c),
    p AS (SELECT doc_id, list(e.code ORDER BY pos) AS codes, list(vs[(('0x' || substr(sha256(doc_id || e.code || 'novice'), 1, 8))::BIGINT % len(vs) + 1)::INT].phrase ORDER BY pos) AS phrases FROM e JOIN v ON v.code = e.code GROUP BY 1),
    s AS (SELECT c.doc_id, verdict, p.codes, coalesce(p.phrases, []) AS ps, k::BIGINT AS pct FROM c LEFT JOIN p ON p.doc_id = c.doc_id)
  SELECT doc_id, 'novice' AS tier, len(ps)::BIGINT AS n, CASE WHEN verdict = 'REAL' THEN 'Looks credible (estimated fake-likelihood ' || pct || '%). ' || array_to_string(ps, ' ')
    WHEN len(ps) = 0 THEN 'Looks suspicious (estimated fake-likelihood ' || pct || '%), but the cues are subtle.'
    ELSE 'Looks suspicious (estimated fake-likelihood ' || pct || '%). ' || len(ps) || CASE WHEN len(ps) = 1 THEN ' cue: ' ELSE ' cues: ' END || array_to_string(codes, ', ') || '. ' || array_to_string(ps, ' ') END AS summary FROM s"""


@query("q_explanations", EXPLAINED)
def explanations(t):
    return explained(t)[1].select("doc_id", "tier", "summary", F.size("indicator_phrases").alias("n"))


AUDIT_MENTIONS = {"EMO": ("emo",), "URG": ("zzz",), "MISS": ("miss",)}


@query(
    "q_faithfulness_audit",
    f"""WITH c AS (SELECT doc_id, verdict, doc_id % 3 AS k FROM {CARDS})
      SELECT issue, count(*) AS n FROM (SELECT unnest(CASE WHEN len(i) = 0 THEN ['passed'] ELSE i END) AS issue FROM (
        SELECT list_filter([CASE WHEN k = 1 AND verdict = 'FAKE' THEN 'empty_explanation_phrases' END, CASE WHEN k = 0 AND verdict <> 'REAL' THEN 'indicator_phrase_mismatch' END], lambda x: x IS NOT NULL) AS i FROM c)) GROUP BY 1""",
)
def faithfulness(t):
    rows, made = explained(t)
    joined = rows.select("doc_id", "fired", "verdict").join(made, "doc_id")
    ref = F.transform("indicator_phrases", lambda p: F.struct(p["indicator"].alias("indicator"), p["phrase"].alias("phrase"), F.regexp_replace(p["bank_ref"], "/v1/", "/v1.0/").alias("bank_ref")))
    issues = EX.audit(F.col("fired"), F.col("verdict"), F.col("summary"), ref, F.lit("v2.9.9"), "1.1", AUDIT_MENTIONS)
    return R.issue_breakdown(joined.select(issues.alias("issues")), "issues")


VEC = "list_transform(embedding, lambda x: x::DOUBLE)"
KNN = """SELECT a.vec_id AS src, b.vec_id AS dst, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.vec_id) AS rank
  FROM (SELECT vec_id, {0} AS v FROM embeddings {1}) a, (SELECT vec_id, {0} AS v FROM embeddings {2}) b WHERE a.vec_id <> b.vec_id QUALIFY rank <= {3}"""


@query("q_knn_edges", KNN.format(VEC, "", "", 10))
def knn(t):
    return GR.knn_edges(t("embeddings"), "vec_id", "embedding", 10).select("src", "dst", "rank")


@query("q_sym_edges", f"WITH k AS ({KNN.format(VEC, '', '', 3)}) SELECT src, count(*) AS n FROM (SELECT src, dst FROM k UNION ALL SELECT dst, src FROM k) GROUP BY 1")
def sym(t):
    return GR.symmetric(GR.knn_edges(t("embeddings"), "vec_id", "embedding", 3)).groupBy("src").agg(F.count("*").alias("n"))


@query("q_attach_new", "SELECT dst AS src, src AS dst, rank FROM (" + KNN.format(VEC, "WHERE vec_id % 10 = 0", "WHERE vec_id % 10 <> 0", 5) + ")")
def attach(t):
    e = t("embeddings")
    return GR.attach(e.filter("vec_id % 10 = 0"), e.filter("vec_id % 10 <> 0"), "vec_id", "embedding", 5)


@query(
    "q_mean_agg",
    f"""WITH v AS (SELECT vec_id, {VEC} AS v FROM embeddings), e AS (SELECT vec_id AS dst, unnest([vec_id // 2, vec_id // 3]) AS src FROM embeddings WHERE vec_id % 4 <> 0)
      SELECT vec_id, coalesce({micro('avg(u.v[1])')}, 0) AS first, coalesce({micro('avg(u.v[64])')}, 0) AS last FROM (SELECT vec_id FROM v) LEFT JOIN e ON e.dst = vec_id LEFT JOIN v u ON u.vec_id = e.src GROUP BY vec_id""".replace("SELECT vec_id, coalesce", "SELECT n.vec_id, coalesce").replace("FROM (SELECT vec_id FROM v) LEFT JOIN e ON e.dst = vec_id", "FROM (SELECT vec_id FROM v) n LEFT JOIN e ON e.dst = n.vec_id").replace("GROUP BY vec_id", "GROUP BY n.vec_id"),
)
def mean_agg(t):
    nodes = t("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    i = F.col("vec_id")
    edges = nodes.filter("vec_id % 4 <> 0").select(i.alias("dst"), F.explode(F.array(F.floor(i / 2), F.floor(i / 3))).alias("src"))
    m = GR.neighbour_mean(nodes, edges, "vec_id", "v")
    return m.select("vec_id", N.micro(F.element_at("mean", 1)).alias("first"), N.micro(F.element_at("mean", 64)).alias("last"))


@query(
    "q_standardise",
    f"""WITH v AS (SELECT vec_id, {VEC} AS v FROM embeddings), s AS (SELECT avg(v[1]) AS m1, stddev_pop(v[1]) AS s1, avg(v[64]) AS m2, stddev_pop(v[64]) AS s2 FROM v WHERE vec_id % 5 <> 0)
      SELECT vec_id, round((v[1] - m1) / s1 * 1000)::BIGINT AS z1, round((v[64] - m2) / s2 * 1000)::BIGINT AS z64 FROM v, s""",
)
def standardise(t):
    nodes = t("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    z = GR.standardise(nodes, "vec_id", "v", F.col("vec_id") % 5 != 0)
    milli = lambda k: F.round(F.element_at("z", k) * 1000).cast("bigint")
    return z.select("vec_id", milli(1).alias("z1"), milli(64).alias("z64"))


@query("q_l2norm", f"SELECT vec_id, {micro('v[1] / greatest(sqrt(list_dot_product(v, v)), 1e-12)')} AS first FROM (SELECT vec_id, {VEC} AS v FROM embeddings)")
def l2norm(t):
    return t("embeddings").select("vec_id", N.micro(F.element_at(N.l2_normalise(F.col("embedding")), 1)).alias("first"))


EQUATION = "logreg(0.5*ldiscount^2 - sqrt(l_tax) + 0.01*l_quantity) + max(l_tax, 0.02)"


@query("q_equation", f"SELECT l_orderkey::BIGINT AS l_orderkey, l_linenumber::BIGINT AS l_linenumber, {micro('1 / (1 + exp(-least(greatest(0.5 * l_discount::DOUBLE * l_discount::DOUBLE - sqrt(l_tax::DOUBLE) + 0.01 * l_quantity::DOUBLE, -60), 60))) + greatest(l_tax::DOUBLE, 0.02)')} AS score FROM lineitem")
def equation(t):
    rows = t("lineitem")
    return rows.select("l_orderkey", "l_linenumber", N.micro(EQ.compile_equation(EQUATION, rows.columns)).alias("score"))


CONDITIONED = f"""WITH b AS (SELECT d.doc_id, d.text, d.lang, l.quality, CASE WHEN l.quality = 1 THEN {P_FAKE.replace('doc_id', 'd.doc_id')} ELSE 1 - {P_FAKE.replace('doc_id', 'd.doc_id')} END AS conf, abs({P_FAKE.replace('doc_id', 'd.doc_id')} - 0.5) AS m
    FROM documents d JOIN labels l ON l.doc_id = d.doc_id), c AS (SELECT quantile_cont(conf, 0.33) AS lo, quantile_cont(conf, 0.67) AS hi, quantile_cont(m, 0.33) AS a, quantile_cont(m, 0.67) AS z FROM b)
  SELECT doc_id, '<|label=' || ['real', 'fake'][quality + 1] || '|> <|ensem=' || CASE WHEN conf >= hi THEN 'high' WHEN conf >= lo THEN 'mid' ELSE 'low' END || '|> <|tier=' ||
    CASE WHEN m >= z THEN 'novice' WHEN m >= a THEN 'proficient' ELSE 'advanced' END || '|> ' || trim(regexp_replace(coalesce(text, ''), '[\\r\\n]+', ' ', 'g')) AS line FROM b, c"""


@query("q_conditioned_corpus", CONDITIONED)
def conditioned(t):
    from quillmesh.plans.corpus import conditioned_corpus

    docs = t("documents").select("doc_id", "text", p_fake().alias("p"))
    return conditioned_corpus(docs, t("labels").select("doc_id", F.col("quality").alias("label")), "doc_id", "text", "p")


DECKS = f"""WITH u AS (SELECT DISTINCT user_id::VARCHAR AS user_id, (('0x' || substr(sha256(user_id || ':pool'), 1, 16))::UBIGINT % 9223372036854775808)::VARCHAR AS seed FROM events),
    cards AS (SELECT *, {sha(1729)} AS h0, row_number() OVER (PARTITION BY verdict ORDER BY {sha(1729)}, doc_id) AS r0, count(*) FILTER (verdict = 'REAL') OVER () AS nr, count(*) FILTER (verdict = 'UNCERTAIN') OVER () AS nu FROM {CARDS}),
    pool AS (SELECT id, verdict FROM cards ORDER BY CASE WHEN verdict = 'REAL' AND r0 <= 105 THEN 1 WHEN verdict = 'UNCERTAIN' AND r0 <= 30 THEN 2 WHEN verdict = 'FAKE' AND r0 <= 300 - least(nr, 105) - least(nu, 30) THEN 3 ELSE 4 END, h0, doc_id LIMIT 300),
    a AS (SELECT user_id, id, verdict, sha256('deck|' || seed || '|' || id) AS h, CASE verdict WHEN 'REAL' THEN 2 WHEN 'UNCERTAIN' THEN 1 ELSE 5 END AS quota FROM u, pool),
    b AS (SELECT *, row_number() OVER (PARTITION BY user_id, verdict ORDER BY h, id) AS r FROM a QUALIFY r <= 56),
    c AS (SELECT *, CASE WHEN r <= quota * 7 THEN 0 WHEN verdict = 'FAKE' THEN 1 WHEN verdict = 'UNCERTAIN' THEN 2 ELSE 3 END AS p FROM b),
    d AS (SELECT *, CASE WHEN p = 0 THEN ceil(r / quota::DOUBLE)::INT ELSE 8 END AS own FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY p, h, id) <= 56),
    e AS (SELECT *, ceil(row_number() OVER (PARTITION BY user_id ORDER BY own, h, id) / 8.0)::BIGINT AS day FROM d),
    f AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY h, id) AS slot FROM e)
  SELECT user_id, day, slot, id, verdict, CASE WHEN verdict = 'FAKE' THEN last_value(CASE WHEN verdict = 'REAL' THEN id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day, slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS counter_id FROM f"""


@query("q_deck_draw", DECKS)
def decks(t):
    pool = K.curate(cards(t), "doc_id", 300).select("id", "verdict")
    users = t("events").select(F.col("user_id").cast("string").alias("user_id")).distinct()
    users = users.withColumn("seed", H.user_seed(F.col("user_id"), F.lit("pool")).cast("string"))
    return K.draw_decks(pool, users, days=7, per_day=8, real_per_day=2)
