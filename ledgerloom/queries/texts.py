"""Further queries on texts, and the SQL of text queries that `reference` registers without."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import markup
from ledgerloom.functions.markup import BATCH, LEAST_CLAUSE, MOST_ENTRY
from ledgerloom.operators import similarity
from ledgerloom.queries.reference import _TEXT, SQL, query
from ledgerloom.sources.tables import table

_SECTIONS = rf"""d AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace({_TEXT}, '(^|\n)(#{{2,3}} )', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: x <> '') AS parts FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS seq FROM d),
s AS (SELECT doc_id, seq, CASE WHEN regexp_matches(part, '^#{{2,3}} ') THEN trim(regexp_extract(part, '^#{{2,3}} ([^\n]*)', 1)) END AS title, CASE WHEN regexp_matches(part, '^#{{2,3}} ') THEN regexp_replace(part, '^[^\n]*\n?', '') ELSE part END AS body FROM p)"""

SQL["section_of_rates"] = f"WITH {_SECTIONS} SELECT doc_id, title, length(body) AS n_chars FROM s WHERE contains(lower(title), 'rates') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY seq) = 1"

SQL["document_clauses"] = rf"""WITH t AS (SELECT doc_id, regexp_replace({_TEXT}, '\n\s*\n', chr(1), 'g') AS t FROM documents WHERE text IS NOT NULL), m AS (SELECT doc_id, regexp_replace(t, '(^|\n|\x01)(#{{1,6}} |\d+(?:\.\d+)+ )', '\1' || chr(1) || '\2', 'g') AS t FROM t),
d AS (SELECT doc_id, list_filter(string_split(t, chr(1)), lambda p: trim(p) <> '') AS parts FROM m), p AS (SELECT doc_id, unnest(parts) AS p, unnest(range(len(parts))) AS seq FROM d),
h AS (SELECT doc_id, seq, trim(p) AS clause, last_value(CASE WHEN regexp_matches(p, '^#{{1,6}} ') THEN trim(regexp_extract(p, '^#{{1,6}} ([^\n]*)', 1)) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY seq) AS heading FROM p)
SELECT doc_id, seq, heading, clause, substr(clause, 1, {MOST_ENTRY}) AS entry FROM h WHERE length(clause) >= {LEAST_CLAUSE}"""

_CELLS = "list_transform(string_split(regexp_replace(trim({0}), '^\\||\\|$', '', 'g'), '|'), lambda c: CASE WHEN trim(c) IN ('', '-', '–', '—', 'n/a') THEN NULL ELSE trim(c) END)"
_ROWS = rf"""d AS (SELECT doc_id, string_split({_TEXT}, chr(10)) AS l FROM documents WHERE contains(text, '|')), x AS (SELECT doc_id, trim(unnest(l)) AS s, unnest(range(len(l))) AS line FROM d),
y AS (SELECT *, starts_with(s, '|') AS r, starts_with(lag(s, 1, '') OVER (PARTITION BY doc_id ORDER BY line), '|') AS before FROM x), z AS (SELECT *, max(CASE WHEN r AND NOT before THEN line END) OVER (PARTITION BY doc_id ORDER BY line) AS head FROM y WHERE r),
w AS (SELECT z.doc_id, z.line, z.head, {_CELLS.format('h.s')} AS header, {_CELLS.format('z.s')} AS cells FROM z JOIN z h ON h.doc_id = z.doc_id AND h.line = z.head WHERE z.line > z.head AND NOT regexp_full_match(z.s, '[|\s:-]+'))"""


def _under(*names: str) -> str:
    """The cell under the first of some headers."""
    return "CASE " + " ".join(f"WHEN list_position(lh, '{n}') > 0 THEN list_extract(cells, CAST(list_position(lh, '{n}') AS INT))" for n in names) + " END"


_BASES = "'per hour', 'per day', 'per night', 'per visit', 'per item', 'per test', 'per procedure', 'per unit dispensed', 'per hour per item'"
SQL["rate_rows"] = rf"""WITH {_ROWS}, c AS (SELECT doc_id, line, cells, list_transform(list_filter(header, lambda h: h IS NOT NULL), lambda h: lower(h)) AS lh FROM w),
v AS (SELECT doc_id, line, {_under('service')} AS service, regexp_replace(lower(trim({_under('basis', 'unit')})), '[\s_-]+', ' ', 'g') AS b, string_split(replace({_under('rate', 'charge', 'price')}, ', later ', ' later '), ' later ')[1] AS r, replace(trim({_under('cap', 'limit')}), ',', '') AS k FROM c),
u AS (SELECT *, CASE WHEN starts_with(b, 'per ') THEN b ELSE 'per ' || b END AS p, regexp_replace(r, '[^0-9.]', '', 'g') AS digits FROM v)
SELECT doc_id, line, service, CASE WHEN p IN ({_BASES}) THEN replace(p, ' ', '_') END AS unit_basis, CAST(TRY_CAST(nullif(digits, '') AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents, TRY_CAST(CASE WHEN regexp_full_match(k, '-?[0-9]{{1,18}}(\.0+)?') THEN regexp_replace(k, '\.0+$', '') END AS BIGINT) AS cap FROM u WHERE service IS NOT NULL"""

_GRAMS = r"""SELECT {keys}, unnest(flatten(list_transform([2, 3, 4], lambda n: flatten(list_transform(list_filter(regexp_split_to_array(lower({text}), '\s+'), lambda w: w <> '' AND (n = 2 OR length(w) + 2 > n - 1)), lambda w: list_transform(range(1, greatest(length(w) + 3 - n, 1) + 1), lambda i: substr(' ' || w || ' ', i, n))))))) AS gram FROM {source}"""
SQL["lexical_best"] = f"""WITH names AS (SELECT contract_id, service, service_ord FROM dim_service), qs AS (SELECT DISTINCT contract_id, description FROM resolution WHERE description IS NOT NULL),
ng AS (SELECT contract_id, service, service_ord, gram, count(*) AS tf FROM ({_GRAMS.format(keys='contract_id, service, service_ord', text='service', source='names')}) GROUP BY ALL), qg AS (SELECT contract_id, description, gram, count(*) AS tf FROM ({_GRAMS.format(keys='contract_id, description', text='description', source='qs')}) GROUP BY ALL),
idf AS (SELECT gram, ln((1 + (SELECT count(*) FROM names)) / (1 + count(*))) + 1 AS idf FROM ng GROUP BY gram),
nw AS (SELECT ng.*, tf * idf AS w, sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY contract_id, service, service_ord)) AS norm FROM ng JOIN idf USING (gram)), qw AS (SELECT qg.*, tf * idf AS w, sqrt(sum((tf * idf) * (tf * idf)) OVER (PARTITION BY contract_id, description)) AS norm FROM qg JOIN idf USING (gram)),
p AS (SELECT q.contract_id, q.description, n.service, n.service_ord, round(sum((q.w / q.norm) * (n.w / n.norm)), 4) AS score FROM qw q JOIN nw n ON n.contract_id = q.contract_id AND n.gram = q.gram GROUP BY ALL)
SELECT contract_id, description, service, score FROM p QUALIFY row_number() OVER (PARTITION BY contract_id, description ORDER BY score DESC, service_ord) = 1"""


@query(f"WITH {_SECTIONS}, n AS (SELECT * FROM s WHERE title IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, title ORDER BY seq DESC) = 1) SELECT doc_id, seq, title, length(body) AS n_chars FROM n")
def last_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Titled sections, of those with one title in a document the last."""
    s = markup.last_sections(markup.sections(table(spark, sf, "documents"), ["doc_id"], "text"), ["doc_id"])
    return s.select("doc_id", "seq", "title", F.length("body").alias("n_chars"))


@query(f"WITH {_SECTIONS} SELECT doc_id, count(*) FILTER (contains(lower(title), 'rates')) AS n_kept, count(*) FILTER (NOT contains(lower(title), 'rates')) AS n_dropped, CAST(coalesce(sum(length(body)) FILTER (NOT contains(lower(title), 'rates')), 0) AS BIGINT) AS chars_dropped FROM s WHERE title IS NOT NULL GROUP BY ALL")
def sections_dropped(spark: SparkSession, sf: str) -> DataFrame:
    """Sections that a filter on their title keeps and drops, with the characters dropped."""
    s = markup.sections(table(spark, sf, "documents"), ["doc_id"], "text").where("title is not null")
    kept = F.contains(F.lower("title"), F.lit("rates"))
    return s.groupBy("doc_id").agg(F.count(F.when(kept, 1)).alias("n_kept"), F.count(F.when(~kept, 1)).alias("n_dropped"), F.coalesce(F.sum(F.when(~kept, F.length("body"))), F.lit(0)).cast("long").alias("chars_dropped"))


_CLAUSE = r"^\d+\.\d+ "


@query(rf"""WITH {_SECTIONS}, k AS (SELECT * FROM s WHERE title IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, title ORDER BY seq DESC) = 1), a AS (SELECT doc_id, title, trim(body, ' ' || chr(9) || chr(10)) AS text, CAST(len(regexp_extract_all(chr(10) || body, '\n\d+\.\d+ ')) AS INT) AS n_clauses FROM k WHERE contains(lower(title), 'rates')),
m AS (SELECT doc_id, string_split(regexp_replace({_TEXT}, '(^|\n)(\d+\.\d+ )', '\1' || chr(1) || '\2', 'g'), chr(1)) AS l FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM a)), c AS (SELECT doc_id, unnest(l) AS c, unnest(range(len(l))) AS i FROM m),
g AS (SELECT doc_id, 'Article ' || split_part(c, '.', 1) AS title, string_agg(trim(c, ' ' || chr(9) || chr(10)), chr(10) || chr(10) ORDER BY i) AS text, CAST(count(*) AS INT) AS n_clauses FROM c WHERE regexp_matches(c, '^\d+\.\d+ ') GROUP BY ALL)
SELECT doc_id, title, length(text) AS n_chars, n_clauses FROM a UNION ALL SELECT doc_id, title, length(text), n_clauses FROM g""")
def rate_articles(spark: SparkSession, sf: str) -> DataFrame:
    """The articles on rates with their clauses counted; without such headings the clauses gathered by article number."""
    a = markup.articles(table(spark, sf, "documents"), ["doc_id"], "text", "rates", _CLAUSE)
    return a.select("doc_id", "title", F.length("text").alias("n_chars"), "n_clauses")


@query(rf"""WITH {_ROWS}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, head ORDER BY line) AS n, count(*) OVER (PARTITION BY doc_id, head) AS a FROM w)
SELECT doc_id, min(n) AS first, max(n) AS last, count(*) AS n_rows, '| ' || list_aggregate(list_transform(any_value(header), lambda h: coalesce(h, '')), 'string_agg', ' | ') || ' |' || chr(10) || string_agg('| ' || list_aggregate(list_transform(cells, lambda h: coalesce(h, '')), 'string_agg', ' | ') || ' |', chr(10) ORDER BY n) AS text FROM k WHERE a >= 3 GROUP BY doc_id, head, (n - 1) // {BATCH}""")
def table_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of tables in lots of fifteen that keep their header; tables of fewer than three rows are left out."""
    return markup.table_batches(markup.table_rows(table(spark, sf, "documents"), ["doc_id"], "text"), ["doc_id"]).select("doc_id", "first", "last", "n_rows", "text")


#: Sentences in which documents state conventions, by the convention.
QUOTES = {
    "rounding": r"rounded before clause[^.\n]*",
    "cap": r"Units of [^.\n]* stay unpaid",
    "weekend": r"Work on a Saturday or Sunday raises[^.\n]*",
    "discount": r"Once more than [^.\n]* lowered by [0-9]+%",
    "window": r"A claim for [^.\n]* is refused",
    "bundle": r"[A-Z][^.\n]* counts as one visit",
}


@query("SELECT doc_id, " + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN trim(regexp_extract(text, '{p}')) END AS {n}" for n, p in QUOTES.items()) + " FROM documents WHERE text IS NOT NULL")
def quoted_conventions(spark: SparkSession, sf: str) -> DataFrame:
    """For each of six conventions the words in which a document states it."""
    return table(spark, sf, "documents").where("text is not null").select("doc_id", *markup.quoted(F.col("text"), QUOTES))


_NAME = r"([A-Z][a-z]+(?: [A-Z][a-z]+)*)"
#: Shapes of sentences that state rules: family -> pattern, and the group of each field.
SHAPES = {
    "cap": (rf"Units of {_NAME} beyond ([0-9]+) on a Service Day", {"service": 1, "number": 2}),
    "rate": (rf"For {_NAME} the Provider may charge GBP ([0-9,]+\.[0-9]{{2}})", {"service": 1, "amount": 2}),
    "discount": (rf"more than ([0-9]+) units of {_NAME} were charged in the term, later units are lowered by ([0-9]+)%", {"service": 2, "number": 1, "percent": 3}),
    "weekend": (rf"Work on a Saturday or Sunday raises the charge for {_NAME} by ([0-9]+)%", {"service": 1, "percent": 2}),
    "window": (rf"A claim for {_NAME} within ([0-9]+) days of {_NAME} is refused", {"service": 1, "number": 2, "other": 3}),
    "bundle": (rf"{_NAME} given together with {_NAME} counts as one visit", {"service": 1, "other": 2}),
    "factor": (rf"applies a factor of ([0-9]+)% to {_NAME}, rounded", {"service": 2, "percent": 1}),
}
_FIELDS = list(dict.fromkeys(f for _, g in SHAPES.values() for f in g))
_STATED = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS family, " + ", ".join(f"unnest(regexp_extract_all(text, '{p}', {g[f]})) AS {f}" if f in g else f"CAST(NULL AS VARCHAR) AS {f}" for f in _FIELDS) + " FROM documents WHERE text IS NOT NULL" for n, (p, g) in SHAPES.items())


@query(f"WITH x AS ({_STATED}) SELECT doc_id, family, service, other, CAST(number AS BIGINT) AS number, CAST(replace(replace(amount, ',', ''), '.', '') AS BIGINT) AS cents, CAST(percent AS BIGINT) AS percent FROM x")
def stated_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rules that sentences of seven shapes state, with what each says."""
    x = markup.stated(table(spark, sf, "documents"), ["doc_id"], "text", SHAPES)
    return x.select("doc_id", "family", "service", "other", F.col("number").cast("long").alias("number"), markup.cents(F.col("amount")).alias("cents"), F.col("percent").cast("long").alias("percent"))


@query(f"""WITH x AS ({_STATED}), n AS (SELECT DISTINCT service FROM dim_service), y AS (SELECT family, service FROM x UNION ALL SELECT family, other FROM x WHERE other IS NOT NULL)
SELECT family, y.service, count(*) AS n FROM y WHERE service NOT IN (SELECT service FROM n) GROUP BY ALL""")
def unknown_in_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Names in stated rules of seven families that no list has."""
    x = stated_rules(spark, sf).select("family", F.explode(F.array_compact(F.array("service", "other"))).alias("service"))
    return x.join(table(spark, sf, "dim_service").select("service").distinct(), "service", "left_anti").groupBy("family", "service").agg(F.count("*").alias("n"))


@query(f"""WITH names AS (SELECT contract_id, service, service_ord FROM dim_service), qs AS (SELECT DISTINCT contract_id, description FROM resolution WHERE description IS NOT NULL),
ng AS (SELECT DISTINCT contract_id, service, gram FROM ({_GRAMS.format(keys='contract_id, service', text='service', source='names')})), qg AS (SELECT DISTINCT contract_id, description, gram FROM ({_GRAMS.format(keys='contract_id, description', text='description', source='qs')}))
SELECT contract_id, description, count(*) AS n_grams, CAST(1.0 AS DOUBLE) AS norm FROM qg WHERE gram IN (SELECT gram FROM ng) GROUP BY ALL""")
def encoded_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    """Descriptions encoded by an encoder fitted once on the services: how many weights each has, and its length."""
    encoder = similarity.Encoder.fit(table(spark, sf, "dim_service").select("contract_id", "service", "service_ord"), "service")
    q = table(spark, sf, "resolution").where("description is not null").select("contract_id", "description").distinct()
    w = encoder.encode(q, ["contract_id", "description"], "description")
    return w.groupBy("contract_id", "description").agg(F.count("*").alias("n_grams"), F.round(F.sqrt(F.sum(F.col("weight") * F.col("weight"))), 6).alias("norm"))
