"""Personal data: base patterns plus information-theoretic sanitisation, in DataFrame functions only.

Base spans (email, ip, card, phone) are the protected entities, the words of
the documents that hold them are terms. Over the whole corpus, with n(c)
documents holding entity c, n(t) holding term t and n(c,t) holding both, a
term discloses PMI(c;t) = log2(P(c|t) / P(c)) of the log2(1 / P(c)) bits that
name c, where P(c) = n(c) / N and P(c|t) is
(n(c,t) + PRIOR P(c)) / (n(t) + PRIOR): a term starts from telling nothing, as
PRIOR documents would show, so few documents weigh less but every pair is
judged. Where the share reaches DISCLOSURE, the term's mentions throughout the
documents that hold c become spans of kind ``term``, but for those inside base
spans; ``sanitise`` generalises the base spans to their kind and removes those
terms.

Edge cases: null and empty texts have no spans; repeated rows count as rows
and get equal spans; equal starts are ordered by kind; overlapping spans are
rewritten as one; an empty table gives an empty result; a clash of names is
resolved for the added columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions.arrays import running
from quillmesh.llm.common import materialise, table

KINDS = ("email", "ip", "card", "phone")
# Possessive loops and look-behinds only keep the search linear: a later start
# in a run of the same characters fails or matches as its first one does.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap conditions without which no valid match can stand.
NEEDS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}
TERM = r"\p{L}{3,}"
#: Share of an entity's bits that a term may disclose, and documents that the lack of a link counts for beforehand.
DISCLOSURE = 0.9
PRIOR = 0.5


SPAN = "struct<kind:string,start:int,end:int,value:string>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    digits = _digits(value)
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(9, 15)


def _entity(kind: str, value: Column) -> Column:
    """The name under which mentions of one value are counted together."""
    return F.concat(F.lit(f"{kind}:"), F.lower(value) if kind in ("email", "ip") else _digits(value))


def base_spans(text: Column, kind: str) -> Column:
    """The valid matches of a kind with their offsets, as an array of SPAN."""
    pattern = PATTERNS[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    heads = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    ends = running(F.zip_with(heads, found, lambda p, m: F.length(p) + F.length(m)), lambda a, b: a + b, F.lit(0), "int")
    rows = F.arrays_zip(found.alias("m"), ends.alias("e"))
    valid = F.filter(rows, lambda r: _valid(kind, r["m"]))
    made = F.transform(
        valid,
        lambda r: F.struct(F.lit(kind).alias("kind"), (r["e"] - F.length(r["m"])).alias("start"), r["e"].alias("end"), _entity(kind, r["m"]).alias("value")),
    )
    return F.when(NEEDS[kind](text), F.coalesce(made, F.array().cast(f"array<{SPAN}>"))).otherwise(F.array().cast(f"array<{SPAN}>"))


def _words(text: Column) -> Column:
    """The lower-cased terms of a text, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def _terms(text: Column) -> Column:
    """The mentions of terms in a text: lower-cased, with offsets."""
    found = F.regexp_extract_all(text, F.lit(TERM), F.lit(0))
    heads = F.slice(F.split(text, TERM, -1), 1, F.size(found))
    ends = running(F.zip_with(heads, found, lambda p, m: F.length(p) + F.length(m)), lambda a, b: a + b, F.lit(0), "int")
    rows = F.arrays_zip(found.alias("m"), ends.alias("e"))
    return F.transform(rows, lambda r: F.struct(F.lower(r["m"]).alias("term"), (r["e"] - F.length(r["m"])).cast("int").alias("start"), r["e"].cast("int").alias("end")))


def find(docs: DataFrame) -> DataFrame:
    """``docs`` with pii_row (an id of the row) and pii_base, the base spans by start and kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    arrays = [base_spans(text, k) for k in KINDS]
    order = F.transform(F.concat(*arrays), lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("o"), s.alias("s")))
    spans = F.transform(F.array_sort(order), lambda x: x["s"])
    return docs.withColumn("pii_base", spans).withColumn("pii_row", F.monotonically_increasing_id())


def _outside() -> Column:
    """Whether the mention t lies in no base span: those are generalised as a whole."""
    return ~F.exists("pii_base", lambda s: (s["start"] <= F.col("t.start")) & (F.col("t.end") <= s["end"]))


def holders(found: DataFrame) -> DataFrame:
    """(pii_row, entity, n_c): the documents of each entity; of entities with the same documents, which are judged alike, one."""
    held = found.filter(F.size("pii_base") > 0).select("pii_row", F.explode(F.array_distinct(F.transform("pii_base", lambda s: s["value"]))).alias("entity"))
    same = [F.bit_xor(F.xxhash64("pii_row", F.lit(k))).alias(f"same_{k}") for k in (0, 1)]
    sets = held.groupBy("entity").agg(F.count("*").alias("n_c"), *same)
    one = sets.groupBy("n_c", "same_0", "same_1").agg(F.min("entity").alias("entity")).select("entity", "n_c")
    return held.join(one, "entity")


def disclosing(docs: DataFrame, found: DataFrame, seen: DataFrame) -> DataFrame:
    """(pii_row, term) whose term discloses too much of an entity in that row; counts are over all documents."""
    total = docs.agg(F.count("*").alias("n_all"))
    held = materialise(holders(found).crossJoin(F.broadcast(total)).filter("n_c < n_all"), "held")  # one row
    known = F.col("n_c") / F.col("n_all")
    share = lambda together: -F.log2((together + PRIOR * known) / (F.col("n_t") + PRIOR) / known) / F.log2(known)
    words = docs.select(F.explode(_words(F.col("text"))).alias("term"))
    by_term = words.groupBy("term").agg(F.count("*").alias("n_t"))
    pairs = seen.select("pii_row", "term").distinct().join(by_term, "term").join(held, "pii_row")
    # n_ct is n_c at most: what does not pass with that needs no count
    pairs = materialise(pairs.filter(share(F.col("n_c")) >= DISCLOSURE), "pairs")
    counted = pairs.groupBy("entity", "term").agg(F.count("*").alias("n_ct"), F.first("n_c").alias("n_c"), F.first("n_t").alias("n_t"), F.first("n_all").alias("n_all"))
    risky = counted.filter(share(F.col("n_ct")) >= DISCLOSURE).select("entity", "term")
    return pairs.join(risky, ["entity", "term"]).select("pii_row", "term").distinct()


def pii_spans(docs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """The ``carry`` columns with pii_base and pii_terms, arrays of spans in code points, ends exclusive.

    Carried columns keep their names, but for those of the two added ones, which win.
    """
    names = [c for c in carry if c.lower() not in ("pii_base", "pii_terms")]
    inner = [f"pii_c{k}" for k in range(len(names))]
    docs = docs.select(F.col("text"), *[F.col(c).alias(k) for c, k in zip(names, inner, strict=True)])
    return _spans_of(docs, tuple(inner)).toDF(*names, "pii_base", "pii_terms")


def _spans_of(docs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    held = F.when(F.size("pii_base") > 0, F.col("text"))
    found = materialise(find(docs).select(*carry, "pii_row", "pii_base", held.alias("pii_held")), "found")
    # few bytes, but much work for each: spread over as many tasks as a shuffle has
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    holding = found.filter(F.col("pii_held").isNotNull()).repartition(tasks, "pii_row")
    seen = materialise(holding.select("pii_row", "pii_base", F.explode(_terms(F.col("pii_held"))).alias("t")).select("pii_row", "t.*", _outside().alias("free")), "mentions")
    risky = disclosing(docs, found, seen)
    hits = seen.filter("free").join(risky, ["pii_row", "term"]).groupBy("pii_row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("pii_terms"))
    hits = materialise(hits, "hits")  # of known size to the planner: rows are shuffled only if it is large
    none = F.array().cast("array<struct<start:int,end:int>>")
    return found.join(hits, "pii_row", "left").select(*carry, "pii_base", F.coalesce("pii_terms", none).alias("pii_terms"))


def _all_spans() -> Column:
    """Base and term spans by start, then kind, then end."""
    kinds = F.array(*map(F.lit, (*KINDS, "term")))
    base = F.transform("pii_base", lambda s: F.struct(s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("o"), s["end"].alias("end")))
    terms = F.transform("pii_terms", lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS) + 1).cast("long").alias("o"), s["end"].alias("end")))
    return F.transform(F.array_sort(F.concat(base, terms)), lambda s: F.struct(F.element_at(kinds, s["o"].cast("int")).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _listed(spans: Column | str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with base spans generalised to ``<kind>`` and disclosing terms removed; null texts stay null."""
    names = docs.columns
    docs = docs.select([F.col(c).alias("text") if c.lower() == "text" else F.col(c).alias(f"pii_c{k}") for k, c in enumerate(names)])
    found = _spans_of(docs, tuple(docs.columns)).withColumn("pii_all", _all_spans())
    reach = running(F.transform("pii_all", lambda s: s["end"]), lambda a, b: F.greatest(a, b), F.lit(0), "int")
    rows = F.arrays_zip(F.col("pii_all").alias("s"), F.concat(F.array(F.lit(0)), reach).alias("before"))
    pieces = F.transform(
        F.filter(rows, lambda r: r["s"].isNotNull() & (r["s"]["start"] >= r["before"])),
        lambda r: F.concat(
            F.substring(F.col("text"), r["before"] + 1, r["s"]["start"] - r["before"]),
            F.when(r["s"]["kind"] == "term", F.lit("")).otherwise(F.concat(F.lit("<"), r["s"]["kind"], F.lit(">"))),
        ),
    )
    tail = F.substring(F.col("text"), F.element_at("pii_reach", -1) + 1, F.length("text"))
    text = F.when(F.size("pii_all") == 0, F.col("text")).otherwise(F.concat(F.array_join(pieces, ""), tail))
    return found.withColumn("pii_reach", reach).withColumn("text", text).select(*docs.columns).toDF(*names)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii_spans(docs, ("doc_id",))
    count = lambda k: F.size(F.filter("pii_base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    sha = F.sha2(_listed("pii_base").cast("binary"), 256)
    return found.select("doc_id", *map(count, KINDS), sha.alias("base_sha256"), _listed(_all_spans()).alias("spans"), F.size("pii_terms").cast("long").alias("n_term"))


def _oracle_kind(order: int, kind: str, pattern: str, valid: str, entity: str) -> str:
    """(r, o, kind, start, end, entity) of the valid matches of a kind; gaps and matches add up to offsets."""
    return f"""SELECT r, {order} AS o, '{kind}' AS kind, stop - length(m) AS start, stop, '{kind}:' || {entity} AS entity
    FROM (SELECT r, m, (sum(length(g) + length(m)) OVER (PARTITION BY r ORDER BY i))::BIGINT AS stop
      FROM (SELECT r, unnest(string_split_regex(t, '{pattern}')) AS g, unnest(list_append(regexp_extract_all(t, '{pattern}'), '')) AS m, unnest(range(0, len(regexp_extract_all(t, '{pattern}')) + 1)) AS i FROM d)) WHERE m <> '' AND {valid}"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(0, length({_DIGITS})), lambda k: CASE WHEN k % 2 = 0 THEN {_DIGITS}[length({_DIGITS}) - k]::INT
    WHEN {_DIGITS}[length({_DIGITS}) - k]::INT > 4 THEN 2 * {_DIGITS}[length({_DIGITS}) - k]::INT - 9 ELSE 2 * {_DIGITS}[length({_DIGITS}) - k]::INT END)) % 10 = 0"""
_BYTE = "^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
_BASE = " UNION ALL ".join(
    _oracle_kind(*args)
    for args in (
        (1, "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true", "lower(m)"),
        (2, "ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", f"len(list_filter(string_split(m, '.'), lambda p: NOT regexp_matches(p, '{_BYTE}'))) = 0", "lower(m)"),
        (3, "card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}", _DIGITS),
        (4, "phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15", _DIGITS),
    )
)

#: Base spans and disclosing terms by hand: every pair of entity and term is counted.
ORACLE_OP4 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), base AS MATERIALIZED ({_BASE}
), held AS (
  SELECT DISTINCT r, entity FROM base
), n_c AS (
  SELECT entity, count(*) AS n_c FROM held GROUP BY 1
), words AS (
  SELECT DISTINCT r, lower(unnest(regexp_extract_all(t, '\p{{L}}{{3,}}'))) AS term FROM d
), n_t AS (
  SELECT term, count(*) AS n_t FROM words GROUP BY 1
), n_ct AS (
  SELECT entity, term, count(*) AS n_ct FROM held JOIN words USING (r) GROUP BY 1, 2
), risky AS (
  SELECT entity, term FROM (SELECT *, n_c / (SELECT count(*) FROM d)::DOUBLE AS known FROM n_ct JOIN n_c USING (entity) JOIN n_t USING (term) WHERE n_c < (SELECT count(*) FROM d))
  WHERE -log2((n_ct + {PRIOR}::DOUBLE * known) / (n_t + {PRIOR}::DOUBLE) / known) / log2(known) >= {DISCLOSURE}::DOUBLE
), gone AS (
  SELECT DISTINCT r, term FROM held JOIN risky USING (entity)
), mentions AS (
  SELECT r, lower(m) AS term, stop - length(m) AS start, stop FROM (SELECT r, m, (sum(length(g) + length(m)) OVER (PARTITION BY r ORDER BY i))::BIGINT AS stop
    FROM (SELECT r, unnest(string_split_regex(t, '\p{{L}}{{3,}}')) AS g, unnest(list_append(regexp_extract_all(t, '\p{{L}}{{3,}}'), '')) AS m, unnest(range(0, len(regexp_extract_all(t, '\p{{L}}{{3,}}')) + 1)) AS i
      FROM d WHERE r IN (SELECT r FROM base))) WHERE m <> ''
), terms AS (
  SELECT r, {len(KINDS) + 1} AS o, 'term' AS kind, start, stop FROM mentions m JOIN gone USING (r, term) WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = m.r AND b.start <= m.start AND m.stop <= b.stop)
), every AS (
  SELECT r, o, kind, start, stop FROM base UNION ALL SELECT * FROM terms
), listed AS (
  SELECT r, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in (*KINDS, 'term'))},
    coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o, stop) FILTER (kind <> 'term'), '') AS b, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o, stop) AS s
  FROM every GROUP BY 1
)
SELECT doc_id, {', '.join(f"coalesce(n_{k}, 0) AS n_{k}" for k in (*KINDS, 'term'))}, sha256(coalesce(b, '')) AS base_sha256, coalesce(s, '') AS spans FROM d LEFT JOIN listed USING (r)
"""
