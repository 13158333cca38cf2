"""Queries over text functions, hashes, numbers and arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions import arrays as A
from quillmesh.functions import hashing as H
from quillmesh.functions import lexicons as L
from quillmesh.functions import numeric as N
from quillmesh.functions import text as X
from quillmesh.plans.registry import CANDIDATE, P_FAKE, clean, count, micro, query

WORDS = r"[\p{L}\p{N}_]+"


def p_fake():
    return (F.col("doc_id") * 7919 % 1000) / F.lit(1000.0)


def candidate():
    return F.element_at(F.array(*map(F.lit, ("C-A", "C-B", "C-C"))), (F.col("doc_id") % 3 + 1).cast("int"))


@query("q_clean_text", f"SELECT doc_id, {clean()} AS clean FROM documents")
def clean_text(t):
    return t("documents").select("doc_id", X.clean_text(F.col("text")).alias("clean"))


@query("q_tidy_punctuation", f"SELECT doc_id, regexp_replace({clean()}, ' +([.,;:!?])', '\\1', 'g') AS tidy FROM documents")
def tidy(t):
    return t("documents").select("doc_id", X.tidy_punctuation(F.col("text")).alias("tidy"))


@query("q_norm_key", f"""SELECT doc_id, trim({clean()}, '!"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~ ') AS norm FROM documents""")
def norm_key(t):
    return t("documents").select("doc_id", X.norm_key(F.col("text")).alias("norm"))


@query(
    "q_lexical_features",
    f"""SELECT doc_id, length(coalesce(text, ''))::BIGINT AS char_len,
      CASE WHEN {clean()} = '' THEN 0 ELSE len(string_split({clean()}, ' ')) END::BIGINT AS word_len,
      {count('!')} AS exclam, {count('[?]')} AS question,
      CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE {micro(count('[\\p{Nd}]') + " / greatest(length(coalesce(text, '')), 1)::DOUBLE")} END::BIGINT AS digit_micro FROM documents""",
)
def lexical(t):
    f = X.lexical_features(F.col("text"))
    return t("documents").select("doc_id", *[f[k].alias(k) for k in ("char_len", "word_len", "exclam", "question")], N.micro(f["digit_ratio"]).alias("digit_micro"))


@query("q_word_count", f"SELECT doc_id, greatest({count(WORDS)}, 1) AS words FROM documents")
def word_count(t):
    return t("documents").select("doc_id", X.word_count(F.col("text")).alias("words"))


CAPS_SQL = r"len(list_filter(regexp_extract_all(coalesce({0}, ''), '[A-Za-z0-9_]+'), lambda w: regexp_full_match(w, '[A-Z]{{3,}}')))"


@query(
    "q_structural_features",
    f"""SELECT page_id, greatest({count(WORDS, 'html')}, 1) AS len_words, length(coalesce(html, ''))::BIGINT AS len_chars,
      {count('(?i)https?://[^\\s)\\]]+', 'html')} AS num_urls, {count('["“”][^"“”]{8,400}["“”]', 'html')} AS num_quotes,
      {micro(CAPS_SQL.format('html') + " / greatest(" + count(WORDS, 'html') + ", 1)::DOUBLE")} AS caps_micro,
      {count('!', 'html')} AS excl_count, {count('[?]', 'html')} AS question_count FROM pages""",
)
def structural(t):
    f = X.structural_features(F.col("html"))
    names = ("len_words", "len_chars", "num_urls", "num_quotes", "excl_count", "question_count")
    return t("pages").select("page_id", *[f[k].alias(k) for k in names], N.micro(f["caps_ratio"]).alias("caps_micro"))


@query("q_last_word", f"""SELECT doc_id, rtrim(lower(string_split({clean()}, ' ')[-1]), '.,;:!?"”') AS last_word FROM documents""")
def last_word(t):
    return t("documents").select("doc_id", X.last_word(F.col("text")).alias("last_word"))


@query("q_snippets", "SELECT doc_id, substr(coalesce(text, ''), 1, 120) AS head, substr(coalesce(text, ''), greatest(40 - 30, 0) + 1, 50 + 30 - greatest(40 - 30, 0)) AS around FROM documents")
def snippets(t):
    return t("documents").select("doc_id", X.preview(F.col("text"), 120).alias("head"), X.snippet(F.col("text"), F.lit(40), F.lit(50)).alias("around"))


@query(
    "q_escape_html",
    """SELECT page_id, replace(replace(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS safe FROM pages""",
)
def escape(t):
    return t("pages").select("page_id", X.escape_html(F.col("html")).alias("safe"))


@query(
    "q_index_code",
    """SELECT doc_id, CASE WHEN k < 26 THEN chr(65 + k::INT) WHEN k < 702 THEN chr(65 + ((k - 26) // 26)::INT) || chr(65 + ((k - 26) % 26)::INT)
      ELSE chr(65 + ((k - 702) // 676)::INT) || chr(65 + ((k - 702) // 26 % 26)::INT) || chr(65 + ((k - 702) % 26)::INT) END AS code
      FROM (SELECT doc_id, doc_id % 5000 AS k FROM documents)""",
)
def index_code(t):
    return t("documents").select("doc_id", X.index_code(F.col("doc_id") % 5000).alias("code"))


@query(
    "q_control_tokens",
    f"""SELECT doc_id, '<|label=' || CASE WHEN {P_FAKE} >= 0.5 THEN 'fake' ELSE 'real' END || '|> <|lang=' || lang || '|> ' ||
      trim(regexp_replace(coalesce(text, ''), '[\\r\\n]+', ' ', 'g')) AS line, lang AS parsed FROM documents""",
)
def control_tokens(t):
    label = X.control_token("label", F.when(p_fake() >= 0.5, "fake").otherwise("real"))
    lang = X.control_token("lang", F.col("lang"))
    return t("documents").select("doc_id", X.conditioned_line([label, lang], F.col("text")).alias("line"), X.control_value(lang).alias("parsed"))


@query("q_fill_slots", "SELECT n_nationkey::BIGINT AS n_nationkey, regexp_replace('News from ' || n_name || ' , day ' || n_regionkey || ' .', ' +([.,;:!?])', '\\1', 'g') AS filled FROM nation")
def fill_slots(t):
    slots = {"place": F.col("n_name"), "day": F.col("n_regionkey").cast("string")}
    return t("nation").select("n_nationkey", X.fill_slots(F.lit("News  from {place} , day {day} ."), slots).alias("filled"))


@query("q_stable_index", "SELECT doc_id, (('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT % 22)::BIGINT AS idx FROM documents")
def stable_index(t):
    return t("documents").select("doc_id", H.stable_index(F.col("doc_id"), 22).alias("idx"))


@query("q_user_seed", "SELECT DISTINCT user_id, (('0x' || substr(sha256(user_id || ':pool'), 1, 16))::UBIGINT % 9223372036854775808)::BIGINT AS seed FROM events")
def user_seed(t):
    return t("events").select("user_id").distinct().select("user_id", H.user_seed(F.col("user_id"), F.lit("pool")).cast("bigint").alias("seed"))


@query("q_pool_hash", "SELECT source, substr(sha256(string_agg(DISTINCT doc_id::VARCHAR, chr(10) ORDER BY doc_id::VARCHAR)), 1, 16) AS digest FROM documents GROUP BY source")
def pool_hash(t):
    return t("documents").groupBy("source").agg(H.set_digest(F.col("doc_id")).alias("digest"))


@query("q_hash_order", "SELECT doc_id, sha256('42|' || doc_id) AS h FROM documents")
def hash_order(t):
    return t("documents").select("doc_id", H.hash_order(42, F.col("doc_id")).alias("h"))


@query(
    "q_numeric",
    f"""SELECT doc_id, {micro('1 / (1 + exp(-least(greatest(x, -60), 60)))')} AS sigmoid, {micro('exp(0.3 * x) / (exp(0.1 * x) + exp(0.3 * x))')} AS softmax,
      {micro('least(greatest(x, 0), 1)')} AS clipped, {micro('abs(p - 0.5)')} AS margin, {micro('CASE WHEN doc_id % 2 = 1 THEN p ELSE 1 - p END')} AS confidence
      FROM (SELECT doc_id, {P_FAKE} AS p, (doc_id % 17 - 8)::DOUBLE AS x FROM documents)""",
)
def numeric(t):
    x = (F.col("doc_id") % 17 - 8).cast("double")
    return t("documents").select(
        "doc_id", N.micro(N.sigmoid(x)).alias("sigmoid"), N.micro(N.softmax_second(0.1 * x, 0.3 * x)).alias("softmax"), N.micro(N.clip(x, 0, 1)).alias("clipped"),
        N.micro(N.margin(p_fake())).alias("margin"), N.micro(N.confidence(p_fake(), F.col("doc_id") % 2)).alias("confidence"),
    )


@query(
    "q_signal_mean",
    f"""SELECT doc_id, {micro('coalesce(list_avg(list_filter([a, b], lambda x: x IS NOT NULL)), 0.5)')} AS mean, {micro('coalesce(a, b, 0.5)')} AS first
      FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE {P_FAKE} END AS a, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE (doc_id % 10) / 10.0::DOUBLE END AS b FROM documents)""",
)
def signal_mean(t):
    a = F.when(F.col("doc_id") % 5 == 0, F.lit(float("nan"))).otherwise(p_fake())
    b = F.when(F.col("doc_id") % 7 != 0, (F.col("doc_id") % 10) / F.lit(10.0))
    return t("documents").select("doc_id", N.micro(N.mean_known(a, b, default=0.5)).alias("mean"), N.micro(N.first_known(a, b)).alias("first"))


@query(
    "q_label_normalise",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END::BIGINT AS label, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END::BIGINT AS flipped FROM orders""",
)
def label_normalise(t):
    name = F.when(F.col("o_orderstatus") == "F", " Fake").when(F.col("o_orderstatus") == "O", "REAL").otherwise("other")
    return t("orders").select("o_orderkey", N.label_of(name).alias("label"), N.label_of(name, flip=True).alias("flipped"))


@query(
    "q_priority_codes",
    """SELECT doc_id, array_to_string((['EMO', 'URG', 'ANON', 'MISS', 'FAB', 'REV', 'ENDO', 'RECF', 'POL', 'CONS', 'DISC', 'IMP'])[1:0] ||
      list_transform(list_sort(list_transform(codes, lambda c: {'p': CASE WHEN list_position(pr, c) > 0 THEN list_position(pr, c) ELSE 99 END, 'i': list_position(codes, c), 'c': c})), lambda s: s.c)[1:3], ',') AS codes
      FROM (SELECT doc_id, ['EMO', 'URG', 'ANON', 'MISS', 'FAB', 'REV', 'ENDO', 'RECF', 'POL', 'CONS', 'DISC', 'IMP'] AS pr,
        [['IMP', 'XX', 'DISC', 'CONS'], ['POL', 'RECF', 'ENDO', 'REV'], ['FAB', 'MISS', 'ANON', 'URG', 'EMO']][(doc_id % 3 + 1)::INT] AS codes FROM documents)""",
)
def priority(t):
    options = [["IMP", "XX", "DISC", "CONS"], ["POL", "RECF", "ENDO", "REV"], ["FAB", "MISS", "ANON", "URG", "EMO"]]
    codes = F.element_at(F.array(*[A.literals(o) for o in options]), (F.col("doc_id") % 3 + 1).cast("int"))
    return t("documents").select("doc_id", F.array_join(A.by_priority(codes, L.PRIORITY), ",").alias("codes"))


@query(
    "q_feature_map",
    """SELECT doc_id, CASE WHEN a AND b THEN 'EMO,URG' WHEN a THEN 'EMO' WHEN b THEN 'URG' ELSE 'MISS' END AS codes, CASE WHEN abs(x) >= abs(y) THEN 'x' ELSE 'y' END AS top
      FROM (SELECT doc_id, doc_id % 2 = 1 AS a, doc_id % 3 = 1 AS b, doc_id % 11 - 5 AS x, doc_id % 13 - 6 AS y FROM documents)""",
)
def feature_map(t):
    i = F.col("doc_id")
    features = F.create_map(F.lit("ind_urg_fired"), (i % 3 == 1).cast("double"), F.lit("ind_emo_fired"), (i % 2 == 1).cast("double"), F.lit("other"), F.lit(5.0))
    values = F.create_map(F.lit("x"), (i % 11 - 5).cast("double"), F.lit("y"), (i % 13 - 6).cast("double"))
    return t("documents").select("doc_id", F.array_join(A.fired_from_map(features), ",").alias("codes"), A.top_by_size(values, 1)[0]["key"].alias("top"))


@query(
    "q_sub_ngrams",
    """SELECT n_nationkey::BIGINT AS n_nationkey, list_contains(['KINGDOM', 'UNITED STATES', 'FRANCE'], n_name) OR n_name LIKE '%KINGDOM%' OR n_name LIKE 'UNITED STATES%' AS allowed,
      (len(string_split(n_name, ' ')) * (len(string_split(n_name, ' ')) + 1) // 2)::BIGINT AS n FROM nation""",
)
def sub_ngrams(t):
    grams = A.sub_ngrams(F.split("n_name", " "))
    return t("nation").select("n_nationkey", A.any_in(grams, ["KINGDOM", "UNITED STATES", "FRANCE"]).alias("allowed"), F.size(grams).alias("n"))


@query(
    "q_json_props",
    """SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, array_to_string(list_sort(list_filter(json_keys(props), lambda x: x <> 'k')), ',') AS extra FROM events""",
)
def json_props(t):
    parsed = F.from_json("props", "k bigint")
    return t("events").select("event_id", parsed["k"].alias("k"), F.array_join(A.unknown_keys(F.col("props"), ["k"]), ",").alias("extra"))


@query("q_candidates", f"SELECT doc_id, {CANDIDATE} AS candidate, {micro(P_FAKE)} AS p FROM documents")
def candidates(t):
    return t("documents").select("doc_id", candidate().alias("candidate"), N.micro(p_fake()).alias("p"))
