"""Queries over names in text, with oracles for an engine whose patterns have no look-around.

The oracle searches a mapped text of the same length, in which every letter
that is not ASCII is a plain word character, so that its ``\\b`` means the same
as the boundaries in ``operators.spans``; names are cut from the text itself.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions import keep_lists as KL
from quillmesh.operators import spans as S
from quillmesh.plans.registry import query, sql_list


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def mapped(t: str) -> str:
    """Underscores as 1, Latin letters with marks as underscores, other letters as 1: one character each."""
    plain = f"regexp_replace({t}, '_', '1', 'g')"
    latin = rf"regexp_replace({plain}, '[À-ÖØ-öø-ÿ]', '_', 'g')"
    return rf"regexp_replace({latin}, '[\x{{100}}-\x{{24F}}\p{{Greek}}\p{{Cyrillic}}\p{{Han}}\p{{Hiragana}}\p{{Katakana}}\p{{Hangul}}\p{{Arabic}}\p{{Hebrew}}\p{{Devanagari}}]', '1', 'g')"


def pattern(p: S.Pattern) -> str:
    space = r"[\s\p{Z}]"
    return quoted(p.groups(r"\b", r"\b", space).replace(f"[-{space}]", r"[-\s\p{Z}]").replace("À-ÿ", "_"))


def total(items: str) -> str:
    return f"coalesce(list_sum(list_transform({items}, lambda x: length(x))), 0)"


def parts(source: str, p: S.Pattern) -> str:
    """(doc_id, t, g, b, o, a): gaps and groups of all matches in the mapped text."""
    groups = ", ".join(f"regexp_extract_all(m, {pattern(p)}, {k}) AS {c}" for k, c in ((1, "b"), (2, "o"), (3, "a")))
    return f"SELECT doc_id, t, string_split_regex(m, {pattern(p)}) AS g, {groups} FROM {source}"


def spans_of(source: str, p: S.Pattern, k: int) -> str:
    """(doc_id, t, k, pattern, start, end, entity) of one pattern."""
    start = f"{total('g[1:i]')} + {total('b[1:i]')} + {total('o[1:i-1]')} + {total('a[1:i-1]')}"
    return f"""SELECT doc_id, {k} AS k, '{p.name}' AS pattern, start, start + length(o[i]) AS "end", substr(t, start + 1, length(o[i])) AS entity
      FROM (SELECT *, ({start})::BIGINT AS start FROM (SELECT *, unnest(generate_series(1, len(o))) AS i FROM ({parts(source, p)})))"""


DOCS = f"docs AS MATERIALIZED (SELECT doc_id, t, {mapped('t')} AS m FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))"
WORDS = r"string_split_regex({0}, '[\s\p{{Z}}]+')"


def all_in(name: str, words) -> str:
    return f"len(list_filter({WORDS.format(name)}, lambda w: NOT list_contains({sql_list(words)}, w))) = 0"


SPANS = f"""found AS ({' UNION ALL '.join(spans_of('docs', p, k) for k, p in enumerate(S.PERSON))}),
  spans AS (SELECT doc_id, start, "end", entity, pattern FROM found WHERE NOT (entity IN ({', '.join(map(quoted, KL.GATE_NON_NAMES))}) OR {all_in('entity', KL.GATE_NON_NAMES)})
    QUALIFY row_number() OVER (PARTITION BY doc_id, start, "end" ORDER BY k) = 1)"""


def greedy(source: str, name: str) -> str:
    """``name``(doc_id, start, end): of the spans of ``source`` those taken by start, the longer first, that do not overlap."""
    first = f'(SELECT doc_id, start, max("end") AS "end" FROM {source} GROUP BY ALL)'
    return f"""{name} AS (SELECT * FROM (SELECT doc_id, start, "end" FROM {first} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY start) = 1)
    UNION ALL SELECT n.doc_id, min(n.start), arg_min(n."end", n.start) FROM {name} c JOIN {first} n ON n.doc_id = c.doc_id AND n.start >= c."end" GROUP BY n.doc_id, c.start)"""


def replaced(chosen: str, value: str) -> str:
    """(doc_id, text): documents with the spans chosen(doc_id, start, end, ...) replaced."""
    return f"""SELECT d.doc_id, coalesce(r.out || substr(d.t, r.last + 1), d.t) AS text FROM docs d LEFT JOIN (
      SELECT doc_id, string_agg(substr(t, before + 1, start - before) || {value}, '' ORDER BY start) AS out, max("end") AS last
      FROM (SELECT c.*, d.t, coalesce(lag(c."end") OVER (PARTITION BY c.doc_id ORDER BY c.start), 0) AS before FROM {chosen} c JOIN docs d USING (doc_id)) GROUP BY doc_id) r USING (doc_id)"""


@query(
    "q_names_min_count",
    f"WITH {DOCS}, n AS ({' UNION ALL '.join(spans_of('docs', p, k) for k, p in enumerate(S.COUNTED))}) SELECT entity AS name, count(*) AS n FROM n WHERE NOT {all_in('entity', S.NON_NAMES)} GROUP BY 1 HAVING count(*) >= 2",
)
def names(t):
    return S.counted_names(t("documents"), "text", 2)


@query("q_person_spans", f"WITH {DOCS}, {SPANS} SELECT * FROM spans")
def person_spans(t):
    return t("documents").select("doc_id", F.explode(S.person_spans(F.col("text"))).alias("s")).select("doc_id", "s.start", "s.end", "s.entity", "s.pattern")


ALLOWED, BLOCKED = ["candidate a", "the"], ["onof", "reth"]
GATE = rf"""WITH RECURSIVE {DOCS}, {SPANS},
  words AS (SELECT *, regexp_split_to_array(lower(trim(regexp_replace(entity, '[\s\p{{Z}}]+', ' ', 'g'))), ' ') AS w FROM spans),
  judged AS (SELECT *, CASE
      WHEN list_has_any(flatten(list_transform(generate_series(1, len(w)), lambda i: list_transform(generate_series(i, len(w)), lambda j: array_to_string(w[i:j], ' ')))), {sql_list(sorted({*ALLOWED, *KL.ORGANISATIONS}))}) THEN 'allowed'
      WHEN list_has_any(list_append(w, array_to_string(w, ' ')), {sql_list(BLOCKED)}) THEN 'blocklist' WHEN len(w) >= 2 OR length(w[1]) >= 4 THEN 'unknown_name' END AS status FROM words),
  held AS (SELECT * FROM judged WHERE status IS NOT NULL),
  tokens AS (SELECT doc_id, unnest(string_split_regex(t, '[A-Za-z0-9]+')) AS gap, unnest(list_append(regexp_extract_all(t, '[A-Za-z0-9]+'), '')) AS word, unnest(generate_series(1, len(string_split_regex(t, '[A-Za-z0-9]+')))) AS i
    FROM docs WHERE regexp_matches(lower(t), '{'|'.join(BLOCKED)}')),
  placed AS (SELECT doc_id, word, (sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS "end" FROM tokens),
  direct AS (SELECT doc_id, "end" - length(word) AS start, "end", word AS entity FROM placed WHERE lower(word) IN ({', '.join(map(quoted, BLOCKED))})),
  alone AS (SELECT d.* FROM direct d WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.doc_id = d.doc_id AND d.start >= h.start AND d."end" <= h."end")),
  foreign_ AS (SELECT doc_id, start, "end" FROM held WHERE status <> 'allowed' UNION ALL SELECT doc_id, start, "end" FROM alone),
  {greedy('foreign_', 'chosen')}, out AS ({replaced('chosen', quoted(S.REDACTION))})
  SELECT o.doc_id, coalesce(n.n, 0) = 0 AS accepted, coalesce(n.n, 0) AS n_foreign, o.text AS redacted FROM out o LEFT JOIN (SELECT doc_id, count(*) AS n FROM foreign_ GROUP BY 1) n USING (doc_id)"""


@query("q_strict_gate", GATE)
def strict(t):
    g = S.strict_gate(t("documents").select("doc_id", "text"), "text", ALLOWED, BLOCKED)
    return g.select("doc_id", "accepted", F.size("foreign").alias("n_foreign"), "redacted")


@query(
    "q_strict_report",
    f"WITH g AS ({GATE}) SELECT count(*) AS n_input, count(*) FILTER (accepted) AS n_kept, count(*) FILTER (NOT accepted) AS n_rejected, sum(n_foreign)::BIGINT AS redactions, round(100.0::DOUBLE * count(*) FILTER (accepted) / count(*), 2) AS pass_rate_pct FROM g",
)
def strict_report(t):
    return S.gate_summary(S.strict_gate(t("documents").select("doc_id", "text"), "text", ALLOWED, BLOCKED))


LETTERS = "CASE WHEN i < 26 THEN chr((65 + i)::INT) WHEN i < 702 THEN chr((65 + (i - 26) // 26)::INT) || chr((65 + (i - 26) % 26)::INT) ELSE chr((65 + (i - 702) // 676)::INT) || chr((65 + (i - 702) // 26 % 26)::INT) || chr((65 + (i - 702) % 26)::INT) END"


@query(
    "q_pseudonymise_people",
    f"""WITH RECURSIVE {DOCS}, {SPANS},
    kept AS ({spans_of('docs', S.Pattern('keep', '(?i)(?:^|[^A-Za-z0-9])', 'candidate a', '(?:[^A-Za-z0-9]|$)'), 0)}),
    free AS (SELECT * FROM spans s WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.doc_id = s.doc_id AND NOT (s."end" <= k.start OR s.start >= k."end"))),
    {greedy('free', 'chosen')},
    named AS (SELECT c.*, substr(d.t, c.start + 1, c."end" - c.start) AS entity FROM chosen c JOIN docs d USING (doc_id)),
    codes AS (SELECT entity, row_number() OVER (ORDER BY min(doc_id * 1000000000 + start)) - 1 AS i FROM named GROUP BY 1),
    coded AS (SELECT n.*, 'Entity ' || {LETTERS} AS code FROM named n JOIN codes USING (entity)),
    out AS ({replaced('coded', 'code')}) SELECT doc_id, text AS pseudonymised FROM out""",
)
def people(t):
    return S.pseudonymise_people(t("documents").select("doc_id", "text"), "doc_id", "text", keep=("Candidate A",))[0]


def rewrite_pass(source: str, k: int, p: S.Pattern) -> str:
    """p{k}(doc_id, t, m, n): one pass of the rewrite over ``source``."""
    keep = S.Keep()
    every, anchors = sql_list(keep.every()), sql_list(keep.anchors())
    words = WORDS.format("o[i]")
    stays = f"list_has_any({words}, {sql_list(keep.canonical)}) OR list_contains({every}, o[i]) OR list_contains({anchors}, {words}[1])"
    whole = lambda i: f"coalesce(b[{i}], '') || coalesce(o[{i}], '') || coalesce(a[{i}], '')"
    before = f"CASE WHEN i > 1 THEN {whole('i - 1')} ELSE '' END || g[i]"
    if p.name == "two_word":
        previous = rf"regexp_extract({before}, '\b([A-Z][a-z]+|[A-Z]{{2,}})[\s\p{{Z}}]*$', 1)"
        following = rf"regexp_extract(substr(g[i + 1] || {whole('i + 1')}, 1, 50), '^[\s\p{{Z}}]+([A-Z][a-z]+)', 1)"
        stays += f" OR list_has_any({words}, {every}) OR list_contains({anchors}, {previous}) OR list_contains({sql_list(keep.institutions)}, {following})"
    if p.name == "bare_single":
        stays += f" OR NOT regexp_matches({before}, '[a-z,\"”(]$')"
    role = f"{sql_list(S.ROLES)}[(('0x' || substr(sha256('{S.SEED}:' || lower(o[i])), 1, 8))::BIGINT % {len(S.ROLES)})::INT + 1]"
    new = {"particle": f"regexp_extract(b[i], '{S.PARTICLES}') || ' ' || {role}", "title": role, "two_word": role}.get(p.name, f"b[i] || {role}")
    start = f"({total('g[1:i-1]')} + {total('b[1:i-1]')} + {total('o[1:i-1]')} + {total('a[1:i-1]')})::BIGINT"
    end = f"({total('g')} - length(g[len(g)]) + {total('b')} + {total('o')} + {total('a')})::BIGINT"
    piece = f"substr(t, {start} + 1, length(g[i])) || CASE WHEN {stays} THEN b[i] || o[i] || a[i] ELSE {new} || a[i] END"
    return f"""x{k} AS MATERIALIZED (SELECT f.*, s.n AS had FROM ({parts(source, p)}) f JOIN {source} s USING (doc_id)),
    y{k} AS MATERIALIZED (SELECT doc_id, CASE WHEN len(o) = 0 THEN t ELSE array_to_string(list_transform(generate_series(1, len(o)), lambda i: {piece}), '') || substr(t, {end} + 1) END AS t,
      had + len(list_filter(generate_series(1, len(o)), lambda i: NOT coalesce({stays}, false))) AS n FROM x{k}),
    p{k} AS MATERIALIZED (SELECT doc_id, t, {mapped('t')} AS m, n FROM y{k})"""


def rewrite_sql() -> str:
    steps, source = [], "p0"
    for k, p in enumerate(S.PASSES, 1):
        steps.append(rewrite_pass(source, k, p))
        source = f"p{k}"
    tidy = r"regexp_replace(trim(regexp_replace(t, '[\s\p{Z}]+', ' ', 'g')), '[\s\p{Z}]+([.,;:!?])', '\1', 'g')"
    return f"WITH {DOCS}, p0 AS (SELECT *, 0 AS n FROM docs), {', '.join(steps)} SELECT doc_id, {tidy} AS text, n::BIGINT AS n FROM {source}"


@query("q_universal_rewrite", rewrite_sql())
def universal(t):
    return t("documents").withColumn("r", S.universal_rewrite(F.col("text"))).select("doc_id", "r.text", "r.n")
