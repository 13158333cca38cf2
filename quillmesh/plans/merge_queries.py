"""Queries over the merge funnel, explanations that take turns, bank statistics, decks and samples of cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.operators import explain as EX
from quillmesh.operators import gates as G
from quillmesh.operators import ranking as K
from quillmesh.operators import reports as R
from quillmesh.plans.gate_queries import QUALITY, RECOVERED
from quillmesh.plans.rank_queries import BANK_VALUES, CARDS, DECKS, bank, cards, decks, sha
from quillmesh.plans.registry import query, sql_list
from quillmesh.sources import writers as W

BANK_KEYS = ("EMO/fake/novice", "URG/fake/novice", "MISS/fake/novice", "MISS/real/novice")
#: Conversations with no candidate, one with a long code, two, and four.
ENDINGS = ("", " Candidate DKR.", " Candidate B and Candidate A.", " Candidate A, Candidate B, Candidate C, Candidate DD.")
CAST = f"(SELECT conv_id, turn, text || {sql_list(ENDINGS)}[(turn % 4 + 1)::INT] AS text FROM conversations)"
MENTION = r"\bCandidate\s+([A-Z]{1,3})\b"
FUNNEL = rf"""SELECT *, CASE WHEN q IS NOT NULL THEN 'quality' WHEN n > 3 OR n = 0 THEN 'candidate_remap' WHEN len(miss) > 0 THEN 'response_bank_coverage' WHEN turn % 5 = 4 THEN 'schema_mapping' END AS reject_stage,
    CASE WHEN q IS NOT NULL THEN q WHEN n > 3 THEN 'too_many_distinct_entities (' || n || ' > 3)' WHEN n = 0 THEN 'no_candidate_reference' WHEN len(miss) > 0 THEN 'unsupported_indicators: [''POL'']' WHEN turn % 5 = 4 THEN 'bad_turn' END AS reject_reason
  FROM (SELECT *, len(list_distinct(regexp_extract_all(coalesce(r, ''), '{MENTION}', 1))) AS n, CASE WHEN turn % 2 = 0 OR turn % 3 = 0 THEN [] ELSE ['POL'] END AS miss
    FROM (SELECT *, {QUALITY} AS q, {RECOVERED} AS r FROM {CAST}))"""


def funnel(t):
    code = F.when(F.col("turn") % 2 == 0, "EMO").when(F.col("turn") % 3 == 0, "URG").otherwise("POL")
    rows = t("conversations").select("conv_id", "turn", F.concat("text", F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("turn") % 4 + 1).cast("int"))).alias("text"))
    broken = F.when(F.col("turn") % 5 == 4, F.array(F.lit("bad_turn"))).otherwise(F.array().cast("array<string>"))
    return G.merge_funnel(rows, "text", BANK_KEYS, F.lit("fake"), F.lit("novice"), F.array(code), broken)


@query(
    "q_merge_funnel",
    f"""SELECT conv_id, turn, reject_stage, reject_reason, CASE WHEN reject_stage IS NULL THEN
      replace(replace(replace(r, 'Candidate DKR', 'Candidate A'), 'Candidate B and Candidate A', 'Candidate A and Candidate #'), 'Candidate #', 'Candidate B') END AS promoted_text FROM ({FUNNEL})""",
)
def merge_funnel(t):
    return funnel(t).select("conv_id", "turn", "reject_stage", "reject_reason", "promoted_text")


@query("q_reject_tally", f"SELECT trim(split_part(reject_reason, ':', 1)) AS reason, count(*) AS n FROM ({FUNNEL}) WHERE reject_reason IS NOT NULL GROUP BY 1")
def tally(t):
    return G.reject_tally(funnel(t))


@query(
    "q_promotion_rate",
    f"SELECT count(*) AS n_attempted, count(*) FILTER (reject_stage IS NULL) AS n_promoted, round(100.0::DOUBLE * count(*) FILTER (reject_stage IS NULL) / count(*), 2) AS promotion_rate_pct FROM ({FUNNEL})",
)
def promotion(t):
    return G.promotion_rate(funnel(t))


FOREIGN = "list_sort(list_filter(list_distinct(c), lambda x: x NOT IN ('A', 'B', 'C')))"
CODES = "[[], ['A'], ['B', 'ZZ', 'AB', 'ZZ'], ['C', 'A']][(doc_id % 4 + 1)::INT]"


@query(
    "q_candidate_filter",
    f"""SELECT doc_id, CASE WHEN len(c) = 0 THEN 'no_candidate_reference' WHEN len(f) > 0 THEN 'foreign_candidate_codes: [''' || array_to_string(f, ''', ''') || ''']' END AS reason
      FROM (SELECT doc_id, c, {FOREIGN} AS f FROM (SELECT doc_id, {CODES} AS c FROM documents))""",
)
def candidate_filter(t):
    some = [F.array().cast("array<string>"), *(F.array(*map(F.lit, x)) for x in (("A",), ("B", "ZZ", "AB", "ZZ"), ("C", "A")))]
    return t("documents").select("doc_id", G.candidate_reason(F.element_at(F.array(*some), (F.col("doc_id") % 4 + 1).cast("int"))).alias("reason"))


FIRST_USERS = "(SELECT DISTINCT user_id FROM events ORDER BY user_id LIMIT 25)"


@query(
    "q_overlap_summary",
    f"""WITH d AS (SELECT DISTINCT user_id AS u, event_type || '/' || date_part('day', ts) AS i FROM events WHERE user_id IN {FIRST_USERS}), s AS (SELECT u, count(*) AS n FROM d GROUP BY 1),
      p AS (SELECT a.u AS a, b.u AS b, 100.0::DOUBLE * (SELECT count(*) FROM d x JOIN d y ON x.i = y.i WHERE x.u = a.u AND y.u = b.u) / a.n AS share FROM s a JOIN s b ON a.u < b.u)
      SELECT count(*) AS n_pairs, round(avg(share), 2) AS mean_overlap_pct, round(max(share), 2) AS max_overlap_pct, round(min(share), 2) AS min_overlap_pct FROM p""",
)
def overlap(t):
    return R.overlap_summary(t("events").select("user_id", F.concat_ws("/", "event_type", F.dayofmonth("ts").cast("string")).alias("item")), "user_id", "item")


@query("q_capacity", "SELECT count(*) AS pool_size, count(*) // 56 AS capacity, round(100.0::DOUBLE * 56 / count(*), 2) AS expected_overlap_pct FROM documents")
def capacity(t):
    return R.capacity(t("documents"))


STATS = {
    "total_entries": "count(*)", "indicators_covered": "count(DISTINCT code) FILTER (code <> 'CREDIBLE')", "credible_affirmations": "count(*) FILTER (code = 'CREDIBLE')",
    **{f"by_tier_{t}": f"count(*) FILTER (tier = '{t}')" for t in ("novice", "proficient", "advanced")},
}


@query("q_bank_stats", f"SELECT unnest({sql_list(STATS)}) AS metric, unnest(v) AS value FROM (SELECT [{', '.join(STATS.values())}] AS v FROM {BANK_VALUES})")
def bank_stats(t):
    return EX.bank_stats(bank(t("region")))


@query(
    "q_credible_entry",
    f"""WITH v AS (SELECT tier, list(bank_id ORDER BY bank_id) AS ids FROM {BANK_VALUES} GROUP BY 1), e AS (SELECT list(bank_id ORDER BY bank_id) AS every FROM {BANK_VALUES}),
      d AS (SELECT doc_id, ['novice', 'advanced', 'expert'][(doc_id % 3 + 1)::INT] AS tier FROM documents)
      SELECT doc_id, coalesce(ids, every)[(('0x' || substr(sha256(doc_id || 'CREDIBLE' || d.tier), 1, 8))::BIGINT % len(coalesce(ids, every)) + 1)::INT] AS bank_id FROM d LEFT JOIN v ON v.tier = d.tier, e""",
)
def credible_entry(t):
    rows = t("documents").select("doc_id", F.element_at(F.array(F.lit("novice"), F.lit("advanced"), F.lit("expert")), (F.col("doc_id") % 3 + 1).cast("int")).alias("tier"))
    entries = bank(rows).select("tier", "bank_id", "phrase", "sift")
    return EX.with_credible_entry(rows, entries, "tier", F.col("doc_id").cast("string")).select("doc_id", F.col("entry.bank_id").alias("bank_id"))


VARIANTS = (("EMO/fake/novice", ("e0", "e1", "e2")), ("URG/fake/novice", ("u0", "u1")), ("CREDIBLE/real/novice", ("c0", "c1", "c2", "c3")))
FIRED = (("EMO", "URG"), (), ("URG", "EMO", "POL"), ("MISS",))
LOST = f"'{EX.MISSING_PHRASE[0].replace(chr(39), chr(39) * 2)}' || c || '{EX.MISSING_PHRASE[1]}'"
ROTATING = f"""WITH b(k, vs) AS (VALUES {", ".join(f"('{k}', {sql_list(vs)})" for k, vs in VARIANTS)}),
    d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'real' ELSE 'fake' END AS l, [{", ".join(f"{sql_list(f)}::VARCHAR[]" for f in FIRED)}][(doc_id % 4 + 1)::INT] AS f FROM documents),
    g AS (SELECT *, CASE WHEN l = 'real' THEN list_append(f, 'CREDIBLE') ELSE f END AS cs FROM d), e AS (SELECT doc_id, l, f, unnest(cs) AS c, generate_subscripts(cs, 1) - 1 AS j FROM g),
    p AS (SELECT e.*, doc_id + CASE WHEN j = len(f) THEN 0 ELSE j END AS i, vs FROM e LEFT JOIN b ON k = c || '/' || l || '/novice'),
    o AS (SELECT doc_id, string_agg(coalesce(vs[(i % len(vs) + 1)::INT], {LOST}) || '|' || c || '/' || l || '/novice/v' || (i % 3) || '|' || CASE WHEN l = 'fake' THEN 'STOP' ELSE 'TRACE' END, ';' ORDER BY j) AS phrases FROM p GROUP BY 1)
  SELECT d.doc_id, (CASE WHEN l = 'fake' THEN {sql_list(EX.INTROS['fake'])} ELSE {sql_list(EX.INTROS['real'])} END)[(d.doc_id % 5 + 1)::INT] || ' '
      || CASE WHEN len(f) > 0 THEN len(f) || ' indicator(s) fired: ' || array_to_string(f, ', ') || '.' ELSE 'No strong indicators fired.' END AS summary,
    coalesce(phrases, '') AS phrases FROM d LEFT JOIN o USING (doc_id)"""


@query("q_explanation_rotating", ROTATING)
def rotating(t):
    fired = [F.array(*map(F.lit, f)) if f else F.array().cast("array<string>") for f in FIRED]
    rows = t("documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "real").otherwise("fake").alias("label"), F.element_at(F.array(*fired), (F.col("doc_id") % 4 + 1).cast("int")).alias("fired"), F.lit("novice").alias("tier"))
    entries = [(k, [(v, f"{v} en", f"{v} act") for v in vs]) for k, vs in VARIANTS]
    own = rows.sparkSession.createDataFrame(entries, "bank_key string, variants array<struct<phrase:string,phrase_en:string,verifier_action:string>>")
    done = EX.rotating_explanation(rows, own, "doc_id", "doc_id", "label", "fired", "tier")
    told = F.transform("indicator_phrases", lambda p: F.concat_ws("|", p["phrase"], p["bank_ref"], p["sift_move"]))
    return done.select("doc_id", "summary", F.array_join(told, ";").alias("phrases"))


SEATS = "floor(raw) + (row_number() OVER (ORDER BY raw - floor(raw) DESC, k DESC) <= 30 - (SELECT sum(floor(raw)) FROM {0}))::INT AS slots FROM {0}"
HELD = "len(list_filter(got, lambda x: x.{0} = r.{0}))"
PILOT = f"""WITH RECURSIVE pool AS (SELECT id, verdict, candidate, ['novice', 'proficient', 'advanced'][(doc_id % 3 + 1)::INT] AS tier, 'tactic' || (doc_id % 5) AS tactic, {sha(1729, 'id')} AS h FROM {CARDS}),
    few AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY verdict, candidate, tier, tactic ORDER BY h, id) <= 30),
    v0 AS (SELECT verdict AS k, 30.0::DOUBLE * count(*) / (SELECT count(*) FROM pool) AS raw FROM pool GROUP BY 1), t0 AS (SELECT tier AS k, 30.0::DOUBLE * count(*) / (SELECT count(*) FROM pool) AS raw FROM pool GROUP BY 1),
    v AS (SELECT k, {SEATS.format('v0')}), t AS (SELECT k, {SEATS.format('t0')}),
    names AS (SELECT candidate AS k, row_number() OVER (ORDER BY candidate) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT candidate FROM few WHERE candidate IS NOT NULL)),
    share AS (SELECT k, 30 // n + (i < 30 % n)::INT AS slots FROM names),
    priced AS (SELECT f.*, v.slots AS vs, t.slots AS ts, share.slots AS cs FROM few f JOIN v ON v.k = f.verdict JOIN t ON t.k = f.tier LEFT JOIN share ON share.k = f.candidate),
    pick AS (SELECT 0 AS step, []::STRUCT(id VARCHAR, verdict VARCHAR, candidate VARCHAR, tier VARCHAR, tactic VARCHAR)[] AS got
      UNION ALL
      SELECT step + 1, list_append(got, arg_min({{'id': id, 'verdict': verdict, 'candidate': candidate, 'tier': tier, 'tactic': tactic}}, {{'a': CASE WHEN free THEN 0 ELSE 1 END, 'b': CASE WHEN free THEN -worth ELSE 0 END, 'h': h, 'i': id}}))
      FROM (SELECT step, got, r.*, {HELD.format('verdict')} < vs AS free,
          10.0 * ({HELD.format('tactic')} = 0)::INT - 3.0 * greatest(0, {HELD.format('candidate')} - coalesce(cs, 0)) - 2.0 * greatest(0, {HELD.format('tier')} - ts) AS worth
        FROM pick, priced r WHERE step < 30 AND NOT list_contains(list_transform(got, lambda x: x.id), r.id)) GROUP BY step, got)
  SELECT x.id, x.verdict, x.candidate, x.tier, x.tactic, k AS pick FROM (SELECT unnest(got) AS x, generate_subscripts(got, 1) AS k FROM pick WHERE step = 30)"""


@query("q_pilot_sample", PILOT)
def pilot(t):
    i = F.col("doc_id")
    pool = cards(t).select("id", "verdict", "candidate", F.element_at(F.array(F.lit("novice"), F.lit("proficient"), F.lit("advanced")), (i % 3 + 1).cast("int")).alias("tier"), F.concat(F.lit("tactic"), (i % 5).cast("string")).alias("tactic"))
    return K.stratified_sample(pool, 30)


@query(
    "q_detector_report",
    f"""WITH d AS (SELECT verdict, doc_id, (doc_id % 10) / 10.0::DOUBLE AS a, (doc_id % 7) / 7.0::DOUBLE AS b, lang FROM {CARDS} WHERE verdict IN ('FAKE', 'REAL')),
      e AS (SELECT 'detector' AS axis, 'a' AS value, (a >= 0.5) = (verdict = 'FAKE') AS r FROM d UNION ALL SELECT 'detector', 'b', (b >= 0.5) = (verdict = 'FAKE') FROM d UNION ALL SELECT 'lang', lang, (b >= 0.5) = (verdict = 'FAKE') FROM d)
      SELECT axis, value, count(*) AS n, count(*) FILTER (r) AS correct, round(count(*) FILTER (r) / count(*) * 1000000)::BIGINT AS accuracy_micro FROM e GROUP BY 1, 2""",
)
def detector_report(t):
    i = F.col("doc_id")
    rows = cards(t).select("verdict", "lang", (i % 10 / F.lit(10.0)).alias("a"), (i % 7 / F.lit(7.0)).alias("b"))
    return R.detector_report(rows, "verdict", ["a", "b"], "b", ["lang"])


@query(
    "q_deck_report",
    f"""WITH decks AS ({DECKS}), d AS (SELECT user_id, day, count(*) AS n, count(DISTINCT candidate) AS c FROM decks JOIN (SELECT id, candidate FROM {CARDS}) USING (id) GROUP BY 1, 2)
      SELECT user_id, sum(n)::BIGINT AS cards, sum(n) < 56 AS exhausted, min(c) AS least_candidates FROM d GROUP BY 1""",
)
def deck_report(t):
    return R.deck_report(decks(t), cards(t), days=7, per_day=8)


BANK_ENTRIES = "bank_id || '|' || phrase || '|' || sift"


@query(
    "q_bank_document",
    f"""SELECT bank_id, code, tier, phrase, sift, '1.1' AS version, (SELECT substr(sha256(string_agg({BANK_ENTRIES}, chr(10) ORDER BY bank_id, code, tier, phrase, sift)), 1, 16) FROM {BANK_VALUES}) AS digest FROM {BANK_VALUES}""",
)
def bank_document(t):
    parsed = F.from_json("json", "struct<bank_version:string,bank_hash:string,entries:array<struct<bank_id:string,code:string,tier:string,phrase:string,sift:string>>>")
    doc = EX.bank_document(bank(t("region")), "1.1").select(parsed.alias("d"))
    return doc.select(F.explode("d.entries").alias("e"), F.col("d.bank_version").alias("version"), F.col("d.bank_hash").alias("digest")).select("e.*", "version", "digest")


TACTICS = ("urgency", "anonymous source")
FORM = "\n".join(x for q, o in W.QUESTIONS for x in ([q, "", W.ANSWER, ""] if o is None else [q, *(f"- [ ] {c}" for c in o or (W.NO_TACTIC, *sorted(TACTICS))), ""])) + "\n---\n"


def text_sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(
    "q_questionnaire",
    f"SELECT conv_id * 1000 + turn AS place, '## Card ' || (conv_id * 1000 + turn) || ' - `' || conv_id || '`' || chr(10) || chr(10) || '> ' || replace(coalesce(text, ''), chr(10), chr(10) || '> ') || chr(10) || chr(10) || {text_sql(FORM)} AS block FROM conversations",
)
def questionnaire(t):
    rows = t("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("place"), "conv_id", "text")
    return W.questionnaire(rows, "place", "conv_id", "text", TACTICS)


@query(
    "q_answer_key",
    f"""SELECT doc_id, '## Card ' || doc_id || ' - `' || id || '`' || chr(10) || chr(10) || '- **Gold verdict:** ' || verdict || chr(10) || '- **Tactic:** `urgency`' || chr(10) || '- **Tier:** novice' || chr(10) || '- **Candidate:** ' || candidate || chr(10)
      || '- **Fired DEPICT indicators:** ' || CASE WHEN doc_id % 2 = 0 THEN 'EMO, URG' ELSE '(none)' END || chr(10) || '- **Justifying phrase:** why' || chr(10) || chr(10) || '---' || chr(10) AS block FROM {CARDS}""",
)
def answer_key(t):
    fired = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("EMO"), F.lit("URG"))).otherwise(F.array().cast("array<string>"))
    return W.answer_key(cards(t), "doc_id", "id", F.col("verdict"), F.lit("urgency"), F.lit("novice"), F.col("candidate"), fired, F.lit("why"))
