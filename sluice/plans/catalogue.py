"""Queries over the sample tables, each with the same result in SQL where SQL can say it.

The tables stand in for postings, jobs and sources of their shape.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dictionaries as d
from ..functions import hashing, search, text
from ..operators import classify, ingest, readmodel, resolve

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

NOW = "1998-08-02 00:00:00"


def query(name: str, sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return add


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


# --- SQL pieces -------------------------------------------------------------


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sql_fold(x: str) -> str:
    out = f"lower({x})"
    for a, b in d.FOLD_EXPANSIONS.items():
        out = f"replace({out}, '{a}', '{b}')"
    return f"strip_accents({out})"


def sql_slug(x: str) -> str:
    forms = "|".join([*d.LEGAL_PHRASES, *d.LEGAL_FORMS])
    words = f"trim(regexp_replace(regexp_replace({sql_fold(f'coalesce({x}, {chr(39) * 2})')}, '[''‘’ʼ`´.]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"
    bare = f"trim(regexp_replace(' ' || {words}, '(?: (?:{forms}))+$', ''))"
    return f"replace(CASE WHEN {bare} <> '' THEN {bare} ELSE {words} END, ' ', '-')"


def sql_title(x: str) -> str:
    words = f"list_filter(regexp_split_to_array({sql_fold(x)}, '[^a-z0-9]+'), lambda w: w <> '')"
    rest = f"list_filter({words}, lambda w: NOT list_contains({sql_list(d.SENIORITY_WORDS)}, w))"
    return f"array_to_string(CASE WHEN len({rest}) > 0 THEN {rest} ELSE {words} END, ' ')"


def sql_tally(x: str, words) -> str:
    return f"len(list_filter(regexp_split_to_array(lower({x}), '[^\\pL]+'), lambda w: list_contains({sql_list(words)}, w)))"


def sql_language(x: str) -> str:
    g, e = sql_tally(x, d.GERMAN_WORDS), sql_tally(x, d.ENGLISH_WORDS)
    return f"CASE WHEN {g} > {e} AND {g} >= 2 THEN 'de' ELSE 'en' END"


def sql_json(x: str) -> str:
    return f"coalesce(CAST(to_json({x}) AS VARCHAR), 'null')"


# --- read model ---------------------------------------------------------------


@query(
    "job_list_page",
    """SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderstatus <> 'F'
       ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC LIMIT 20 OFFSET 40""",
)
def job_list_page(t):
    rows = t("orders").filter("o_orderstatus <> 'F'").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    return readmodel.page_of(rows, [F.desc_nulls_last("o_orderdate"), F.desc_nulls_last("o_orderkey")], 3, 20)


@query("page_total", "SELECT count(*) AS total FROM orders WHERE o_orderstatus <> 'F'")
def page_total(t):
    return t("orders").filter("o_orderstatus <> 'F'").agg(F.count("*").alias("total"))


@query(
    "source_count",
    """SELECT o.o_orderkey, coalesce(c.source_count, 0) AS source_count FROM orders o
       LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_suppkey) AS source_count FROM lineitem GROUP BY l_orderkey) c ON o.o_orderkey = c.l_orderkey""",
)
def source_count(t):
    counts = readmodel.source_counts(t("lineitem"), "l_orderkey", "l_suppkey")
    return t("orders").select("o_orderkey").join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("source_count", F.lit(0)).alias("source_count"))


@query(
    "detail_sources",
    """SELECT l_orderkey, string_agg(n_name || ':' || s_name || ':' || l_linenumber, '|' ORDER BY n_name, s_name, l_linenumber) AS sources
       FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY l_orderkey""",
)
def detail_sources(t):
    # nation is a fixed dimension of countries; the planner decides about supplier
    sources = t("supplier").join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name")
    rows = t("lineitem").select("l_orderkey", "l_suppkey", "l_linenumber").join(sources, F.col("l_suppkey") == F.col("s_suppkey"))
    made = readmodel.nested(rows, "l_orderkey", [F.col("n_name"), F.col("s_name"), F.col("l_linenumber")], "s")
    return made.select("l_orderkey", F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["n_name"], x["s_name"], x["l_linenumber"])), "|").alias("sources"))


@query(
    "current_classification",
    """SELECT o_orderkey, l_linenumber, l_shipdate FROM orders LEFT JOIN
       (SELECT * FROM lineitem WHERE l_returnflag <> 'R' QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC) = 1) ON o_orderkey = l_orderkey""",
)
def current_classification(t):
    rows = t("lineitem").filter("l_returnflag <> 'R'").select("l_orderkey", "l_linenumber", "l_shipdate")
    best = readmodel.latest(rows, "l_orderkey", [F.desc("l_shipdate"), F.desc("l_linenumber")])
    return t("orders").join(best, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "l_linenumber", "l_shipdate")


@query(
    "profile_default",
    """SELECT c_custkey, coalesce(n, 0) AS saved, coalesce(last, TIMESTAMP '1970-01-01') AS last_saved FROM customer
       LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey""",
)
def profile_default(t):
    per = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last"))
    return t("customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("saved"), F.coalesce("last", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).alias("last_saved"))


@query(
    "facet_search",
    f"""SELECT o_orderkey, techs FROM (SELECT o_orderkey, o_orderdate, o_orderpriority, o_orderstatus FROM orders) o JOIN
        (SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_returnflag || l_linestatus))), ',') AS techs, list_distinct(list(l_returnflag || l_linestatus)) AS a FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey
        WHERE list_contains(a, 'NO') AND o_orderstatus IN ('O', 'P') AND o_orderpriority NOT IN ('5-LOW', '4-NOT SPECIFIED') AND o_orderdate >= TIMESTAMP '{NOW}' - INTERVAL 365 DAY""",
)
def facet_search(t):
    techs = t("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set(F.concat("l_returnflag", "l_linestatus"))).alias("technologies"))
    level = F.when(F.col("o_orderpriority") == "5-LOW", "CLEARLY_EXPERIENCED").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "EXPERIENCED").otherwise("AMBIGUOUS")
    jobs = t("orders").join(techs, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "technologies", F.col("o_orderstatus").alias("workplace_type"), F.col("o_orderdate").alias("effective_posted_at"), level.alias("junior_level"))
    return readmodel.facets(jobs, now(), technologies=["NO"], workplace=["O", "P"], posted_within_days=365).select("o_orderkey", F.array_join("technologies", ",").alias("techs"))


@query(
    "relevance_rank",
    f"""SELECT o_orderkey, round(score, 6) AS score FROM (SELECT o_orderkey, 0.4 * least(o_totalprice / 500000, 1) + 0.3 * (o_custkey % 101) / 100.0 + 0.2 * pow(0.5, greatest(date_diff('day', o_orderdate, TIMESTAMP '{NOW}'), 0) / 30.0)
        + 0.1 * CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS score FROM orders) ORDER BY score DESC, o_orderkey DESC LIMIT 50""",
)
def relevance_rank(t):
    fit = readmodel.profile_fit(F.array("o_orderpriority"), F.array(F.lit("1-URGENT")))
    age = F.timestamp_diff("DAY", F.date_trunc("day", "o_orderdate"), now())
    score = readmodel.relevance(F.least(F.col("o_totalprice") / 500000, F.lit(1.0)), F.col("o_custkey") % 101, age, fit)
    return t("orders").select("o_orderkey", score.alias("s")).orderBy(F.desc("s"), F.desc("o_orderkey")).limit(50).select("o_orderkey", F.round("s", 6).alias("score"))


@query(
    "saved_jobs",
    """WITH w AS (SELECT o_custkey AS user_id, o_orderkey % 100 AS job_id, min(o_orderdate) AS saved_at FROM orders GROUP BY ALL),
       s AS (SELECT o_custkey AS user_id, o_orderkey % 100 AS job_id, max(o_orderdate) AS saved_at FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)
       SELECT * FROM s UNION ALL SELECT w.* FROM w WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = w.user_id AND s.job_id = w.job_id)""",
)
def saved_jobs(t):
    o = t("orders").select(F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 100).alias("job_id"), F.col("o_orderdate").alias("saved_at"), "o_orderstatus")
    saved = o.filter("o_orderstatus = 'F'").groupBy("user_id", "job_id").agg(F.max("saved_at").alias("saved_at"))
    return readmodel.save_jobs(saved, o.drop("o_orderstatus"))


@query("table_counts", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in ("region", "nation", "customer", "supplier", "part", "orders")))
def table_counts(t):
    parts = [t(n).agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in ("region", "nation", "customer", "supplier", "part", "orders")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "profile_upsert",
    """SELECT c_custkey, CASE WHEN i.k IS NOT NULL THEN i.name ELSE c.c_name END AS c_name, CASE WHEN i.k IS NOT NULL THEN i.bal ELSE c.c_acctbal END AS c_acctbal, c.c_mktsegment
       FROM customer c LEFT JOIN (SELECT c_custkey AS k, upper(c_name) AS name, 0.0 AS bal FROM customer WHERE c_custkey % 7 = 0) i ON c.c_custkey = i.k""",
)
def profile_upsert(t):
    base = t("customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    incoming = base.filter("c_custkey % 7 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), F.lit(0.0).alias("c_acctbal"))
    return readmodel.upsert(base, incoming, ["c_custkey"])


# --- text ------------------------------------------------------------------


@query("language_detect", f"SELECT doc_id, {sql_tally('text', d.GERMAN_WORDS)} AS german, {sql_tally('text', d.ENGLISH_WORDS)} AS english, {sql_language('text')} AS language, CASE WHEN {sql_language('text')} = 'de' THEN 'german' ELSE 'english' END AS configuration FROM documents")
def language_detect(t):
    n = text.language_tallies(F.col("text"))
    language = text.detect_language(F.lit(None).cast("string"), F.col("text"), F.lit(None).cast("string"))
    return t("documents").select("doc_id", n["german"].alias("german"), n["english"].alias("english"), language.alias("language"), text.search_configuration(language).alias("configuration"))


@query("declared_language", "SELECT doc_id, CASE WHEN lower(lang) IN ('de', 'en') THEN lower(lang) END AS declared FROM documents")
def declared_language(t):
    return t("documents").select("doc_id", text.declared_language(F.concat(F.upper("lang"), F.lit("_XX"))).alias("declared"))


@query("company_slug", f"SELECT c_custkey, {sql_slug('n')} AS slug FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_name || ' GmbH & Co. KG' WHEN 1 THEN c_name || ', S.à r.l.' WHEN 2 THEN 'Müller ' || c_mktsegment || ' A/S' WHEN 3 THEN 'Limited' ELSE c_name END AS n FROM customer)")
def company_slug(t):
    k = F.col("c_custkey") % 5
    name = F.when(k == 0, F.concat("c_name", F.lit(" GmbH & Co. KG"))).when(k == 1, F.concat("c_name", F.lit(", S.à r.l."))).when(k == 2, F.concat(F.lit("Müller "), "c_mktsegment", F.lit(" A/S"))).when(k == 3, "Limited").otherwise(F.col("c_name"))
    return t("customer").select("c_custkey", text.company_slug(name, normalized=True).alias("slug"))


@query("title_normalize", f"SELECT p_partkey, {sql_title('p_type')} AS title, {sql_title('p_name')} AS name FROM (SELECT p_partkey, 'Senior ' || p_type AS p_type, p_name FROM part)")
def title_normalize(t):
    return t("part").select("p_partkey", text.normalized_title(F.concat(F.lit("Senior "), "p_type", F.lit(" (m/w/d)"))).alias("title"), text.normalized_title(F.col("p_name")).alias("name"))


_COUNTRY_SQL = "CASE " + " ".join(f"WHEN regexp_replace({sql_fold('n_name')}, '[^a-z0-9]+', '', 'g') = '{k}' THEN '{v}'" for k, v in text.COUNTRY_BY_KEY.items()) + " END"


@query("country_parse", f"SELECT c_custkey, CASE WHEN code IS NULL THEN c_name || ', ' || n_name ELSE c_name END AS location, code AS country_code FROM (SELECT c_custkey, c_name, n_name, {_COUNTRY_SQL} AS code FROM customer JOIN nation ON c_nationkey = n_nationkey)")
def country_parse(t):
    named = t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.withColumn("x", text.parse_location(F.concat("c_name", F.lit(" ("), "n_name", F.lit(")")))).select("c_custkey", "x.location", "x.country_code")


@query("whitespace_collapse", r"SELECT doc_id, sha256(regexp_replace(trim(text, chr(9) || chr(10) || chr(13) || ' '), '[\t\n\x0B\f\r ]+', ' ', 'g')) AS collapsed, sha256(regexp_replace(lower(trim(text, chr(9) || chr(10) || chr(13) || ' ')), '[\t\n\x0B\f\r ]+', '-', 'g')) AS slug FROM documents")
def whitespace_collapse(t):
    return t("documents").select("doc_id", F.sha2(text.collapse_space(F.col("text")), 256).alias("collapsed"), F.sha2(text.profile_slug(F.col("text")), 256).alias("slug"))


@query("plain_text")
def plain_text(t):
    return t("documents").select("doc_id", F.sha2(text.plain_text(F.col("text")), 256).alias("plain_sha256"))


@query("html_text")
def html_text(t):
    return t("pages").select("page_id", text.html_text(F.col("html")).alias("plain"))


@query("markup_test", r"SELECT page_id, regexp_matches(html, '</?[a-zA-Z][a-zA-Z0-9-]*(?:[\t\n\x0B\f\r ][^>]*)?/?>') AS page, regexp_matches(url, '</?[a-zA-Z][a-zA-Z0-9-]*(?:[\t\n\x0B\f\r ][^>]*)?/?>') AS url FROM pages")
def markup_test(t):
    return t("pages").select("page_id", text.has_markup(F.col("html")).alias("page"), text.has_markup(F.col("url")).alias("url"))


@query("technologies", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'java,postgresql,spring,spring-boot' WHEN 1 THEN 'aspnet,csharp' WHEN 2 THEN '' ELSE 'cpp,golang,nodejs' END AS technologies FROM part")
def technologies(t):
    k = F.col("p_partkey") % 4
    said = F.when(k == 0, "Java, Spring Boot and Postgres.").when(k == 1, "C# with ASP.NET").when(k == 2, "we go to conferences").otherwise("Go developer: C++, Node.js")
    return t("part").select("p_partkey", F.array_join(text.technologies(F.lit("About the job"), said), ",").alias("technologies"))


@query(
    "workplace_employment",
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'HYBRID' WHEN 1 THEN NULL WHEN 2 THEN 'REMOTE' WHEN 3 THEN 'ONSITE' WHEN 4 THEN 'HYBRID' ELSE 'ONSITE' END AS workplace,
       CASE o_orderkey % 6 WHEN 0 THEN 'WORKING_STUDENT' WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN 'INTERNSHIP' WHEN 4 THEN 'PART_TIME' ELSE 'CONTRACT' END AS employment FROM orders""",
)
def workplace_employment(t):
    k = F.col("o_orderkey") % 6
    said = (
        F.when(k == 0, "Remote or on-site, als Werkstudent").when(k == 1, "no remote work, full time").when(k == 2, "No remote here? You can work from home, we are fully remote; not full time")
        .when(k == 3, "Praktikum, nicht remote").when(k == 4, "2 days per week in the office, Teilzeit").otherwise("Vor ort in Köln, freelance")
    )
    none = F.lit(None).cast("string")
    return t("orders").select("o_orderkey", text.workplace_type(F.lit("Job"), none, said, none).alias("workplace"), text.employment_type(F.lit("Job"), said, none).alias("employment"))


@query("duration_parse", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS BIGINT) WHEN 1 THEN CAST(p_size AS BIGINT) * 60000 WHEN 2 THEN CAST(p_size AS BIGINT) * 86400000 END AS ms FROM part")
def duration_parse(t):
    k = F.col("p_partkey") % 4
    unit = F.when(k == 0, "ms").when(k == 1, "m").when(k == 2, "d").otherwise("w")
    return t("part").select("p_partkey", text.duration_ms(F.concat(F.col("p_size").cast("string"), unit)).alias("ms"))


@query(
    "array_normalize",
    r"SELECT p_partkey, array_to_string(list_distinct_kept, ',') AS roles, len(list_distinct_kept) <= 2 AS short FROM (SELECT p_partkey, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_kept FROM (SELECT p_partkey, [lower(p_brand), lower(p_type), lower(p_brand)] AS l FROM part))",
)
def array_normalize(t):
    roles = F.array_distinct(F.filter(F.transform(F.array(F.concat(F.lit(" "), "p_brand"), F.col("p_type"), F.upper("p_brand"), F.lit("  ")), lambda x: F.lower(text.collapse_space(x))), lambda x: x != ""))
    return t("part").select("p_partkey", F.array_join(roles, ",").alias("roles"), (F.size(roles) <= 2).alias("short"))


@query(
    "response_classes",
    """SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'access_denied' WHEN 1 THEN 'rate_limited' WHEN 2 THEN 'unavailable' WHEN 3 THEN 'protocol' WHEN 4 THEN 'blocked' WHEN 5 THEN 'protocol' WHEN 6 THEN 'ok' ELSE 'protocol' END AS kind FROM events""",
)
def response_classes(t):
    k = F.col("event_id") % 8
    status = F.element_at(F.array(*map(F.lit, (403, 429, 503, 404, 200, 200, 200, 200))), (k + 1).cast("int"))
    kind = F.when(k.isin(4, 5), "text/html; charset=utf-8").otherwise("application/json")
    body = F.when(k == 4, "<html>Are you a robot?").when(k == 7, "{broken").otherwise(F.col("props"))
    return t("events").select("event_id", text.response_class(status, kind, body).alias("kind"))


# --- hashes and resolution ---------------------------------------------------


@query("dedup_hash", f"SELECT c_custkey, sha256({sql_slug('c_name')} || '|' || {sql_title('c_mktsegment')} || '|' || CASE WHEN c_nationkey % 3 = 0 THEN '' ELSE upper(trim('d' || c_nationkey)) END) AS h FROM customer")
def dedup_hash(t):
    country = F.when(F.col("c_nationkey") % 3 != 0, F.concat(F.lit(" d"), F.col("c_nationkey").cast("string")))
    return t("customer").select("c_custkey", hashing.dedup_hash(text.company_slug(F.col("c_name"), normalized=True), text.normalized_title(F.col("c_mktsegment")), country).alias("h"))


@query(
    "posting_hash",
    "SELECT o_orderkey, sha256("
    + " || chr(0) || ".join([*[sql_json(c) for c in ("'https://x/' || o_orderkey", "o_orderpriority", "o_orderstatus", "lower(o_orderstatus)", "NULLIF(o_orderstatus, 'F')", "''", "CAST(NULL AS VARCHAR)", "'FULL_TIME'", "'en'", "o_orderpriority || chr(10) || '\"'", "'a,b'")], sql_json("strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ')")])
    + ") AS h FROM orders",
)
def posting_hash(t):
    s = F.col("o_orderstatus")
    h = hashing.posting_hash(
        F.concat(F.lit("https://x/"), F.col("o_orderkey").cast("string")), F.col("o_orderpriority"), s, F.lower(s), F.nullif(s, F.lit("F")), F.lit(""), F.lit(None).cast("string"), F.lit("FULL_TIME"), F.lit("en"),
        F.concat("o_orderpriority", F.lit('\n"')), F.array(F.lit("b"), F.lit("a")), F.col("o_orderdate"),
    )
    return t("orders").select("o_orderkey", h.alias("h"))


@query("canonical_json")
def canonical_json(t):
    payload = F.concat(F.lit('{"z": [1.0, 1e21, {"t": 1}], "t": 3, "p": '), "props", F.lit("}"))
    return t("events").select("event_id", hashing.canonical_json(payload, ("t", "z.t")).alias("canonical"), hashing.payload_hash(payload, ("t", "z.t")).alias("h"))


_ORDER_ROWS = "SELECT o_custkey AS source_id, o_orderkey % 50 AS external_id, sha256(o_orderstatus || o_orderpriority) AS content_hash, o_orderkey AS ingest_pos, o_orderdate FROM orders"


@query(
    "tier1_outcome",
    f"""WITH rows AS ({_ORDER_ROWS}), old AS (SELECT source_id, external_id, arg_max(content_hash, ingest_pos) AS h, max(ingest_pos) % 3 <> 0 AS active FROM rows WHERE o_orderdate < TIMESTAMP '1995-01-01' GROUP BY ALL),
        new AS (SELECT *, row_number() OVER w AS n, lag(content_hash) OVER w AS before FROM rows WHERE o_orderdate >= TIMESTAMP '1994-01-01' WINDOW w AS (PARTITION BY source_id, external_id ORDER BY ingest_pos))
        SELECT new.source_id, new.external_id, ingest_pos, CASE WHEN n > 1 THEN CASE WHEN before = content_hash THEN 'UNCHANGED' ELSE 'UPDATED' END WHEN old.h IS NULL THEN 'CREATED' WHEN old.h = content_hash AND old.active THEN 'UNCHANGED' ELSE 'UPDATED' END AS outcome
        FROM new LEFT JOIN old ON new.source_id = old.source_id AND new.external_id = old.external_id""",
)
def tier1_outcome(t):
    rows = t("orders").select(F.col("o_custkey").alias("source_id"), (F.col("o_orderkey") % 50).alias("external_id"), F.sha2(F.concat("o_orderstatus", "o_orderpriority"), 256).alias("content_hash"), F.col("o_orderkey").alias("ingest_pos"), "o_orderdate")
    old = rows.filter("o_orderdate < timestamp_ntz'1995-01-01'").groupBy("source_id", "external_id").agg(F.max_by("content_hash", "ingest_pos").alias("content_hash"), (F.max("ingest_pos") % 3 != 0).alias("is_active"))
    return resolve.posting_outcomes(old, rows.filter("o_orderdate >= timestamp_ntz'1994-01-01'")).select("source_id", "external_id", "ingest_pos", "outcome")


@query(
    "tier2_cluster",
    """WITH p AS (SELECT doc_id, sha256(text) AS h, CASE WHEN doc_id % 11 = 0 THEN 'own-' || doc_id END AS job FROM documents), j AS (SELECT h, 'known-' || min(doc_id) AS job FROM p WHERE doc_id % 5 = 0 GROUP BY h)
       SELECT doc_id, CASE WHEN p.job IS NOT NULL THEN 'ALREADY_CLUSTERED' WHEN j.job IS NOT NULL OR row_number() OVER (PARTITION BY p.h, p.job IS NULL ORDER BY doc_id) > 1 THEN 'MATCHED' ELSE 'CREATED' END AS outcome,
       coalesce(p.job, j.job, 'job-' || p.h) AS assigned_job_id FROM p LEFT JOIN j ON p.h = j.h""",
)
def tier2_cluster(t):
    p = t("documents").select(F.col("doc_id").alias("posting_id"), F.sha2("text", 256).alias("dedup_hash"), F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("own-"), F.col("doc_id").cast("string"))).alias("job_id"), F.col("doc_id").alias("ingest_pos"))
    jobs = p.filter("posting_id % 5 = 0").groupBy("dedup_hash").agg(F.concat(F.lit("known-"), F.min("posting_id").cast("string")).alias("job_id"))
    return resolve.cluster(p, jobs).select(F.col("posting_id").alias("doc_id"), "outcome", "assigned_job_id")


_GRAMS = "list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


@query(
    "tier3_trigram",
    f"""WITH g AS (SELECT p_brand AS block, p_partkey AS k, {_GRAMS} AS g FROM part)
        SELECT block, key_a, key_b, round(s, 9) AS similarity FROM (SELECT a.block, a.k AS key_a, b.k AS key_b, len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) AS s FROM g a JOIN g b ON a.block = b.block AND a.k < b.k) WHERE s >= 0.6""",
)
def tier3_trigram(t):
    return resolve.fuzzy_pairs(t("part"), "p_brand", "p_partkey", "p_name", 0.6).withColumn("similarity", F.round("similarity", 9))


_CHAIN = "SELECT c_custkey AS id, CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 29 = 1 THEN c_custkey WHEN c_custkey % 31 = 2 THEN c_custkey + 1000000 ELSE c_custkey + 1 END AS nxt FROM customer"


@query(
    "merge_chain",
    f"""WITH RECURSIVE j AS ({_CHAIN}), w(id, cur, nxt, hop) AS (SELECT id, id, nxt, 0 FROM j UNION ALL SELECT w.id, j.id, j.nxt, hop + 1 FROM w JOIN j ON w.nxt = j.id WHERE hop < 8)
        SELECT j.id AS job_id, r.cur AS canonical_id, CASE WHEN r.cur <> j.id THEN j.id END AS redirected_from FROM j LEFT JOIN (SELECT id, cur FROM w WHERE nxt IS NULL) r ON j.id = r.id""",
)
def merge_chain(t):
    c = F.col("c_custkey")
    jobs = t("customer").select(c.alias("job_id"), F.when(c % 13 == 0, None).when(c % 29 == 1, c).when(c % 31 == 2, c + 1000000).otherwise(c + 1).alias("merged_into"))
    return resolve.resolve_chains(jobs).withColumn("redirected_from", F.when(F.col("canonical_id") != F.col("job_id"), F.col("job_id")))


_CHAIN_WRITE = "SELECT c_custkey AS id, CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 17 = 1 THEN c_custkey - 3 WHEN c_custkey % 31 = 2 THEN c_custkey + 1000000 ELSE c_custkey + 1 END AS nxt FROM customer"


@query(
    "merge_chain_write",
    f"""WITH RECURSIVE j AS ({_CHAIN_WRITE}), w(id, path, nxt, hop) AS (SELECT id, [id], nxt, 0 FROM j UNION ALL SELECT w.id, list_append(w.path, j.id), j.nxt, hop + 1 FROM w JOIN j ON w.nxt = j.id WHERE hop < 10 AND NOT list_contains(w.path, j.id)),
        l AS (SELECT id, arg_max(path, hop) AS path, arg_max(coalesce(nxt, -1), hop) AS nxt, max(hop) AS hop FROM w GROUP BY id)
        SELECT id AS job_id, CASE WHEN hop < 10 AND list_contains(path, nxt) THEN nxt ELSE path[-1] END AS canonical_id FROM l""",
)
def merge_chain_write(t):
    c = F.col("c_custkey")
    jobs = t("customer").select(c.alias("job_id"), F.when(c % 13 == 0, None).when(c % 17 == 1, c - 3).when(c % 31 == 2, c + 1000000).otherwise(c + 1).alias("merged_into"))
    return resolve.resolve_chains(jobs, hops=10, cycle_to_repeat=True)


@query(
    "richest_merge",
    "SELECT source, lang, arg_min(doc_id, (-length(coalesce(text, '')), doc_id)) AS doc_id, count(*) AS n_postings FROM documents GROUP BY source, lang",
)
def richest_merge(t):
    docs = t("documents").withColumn("c", F.struct("source", "lang"))
    return resolve.richest(docs, "c", "text", "doc_id").select("c.source", "c.lang", "doc_id", "n_postings")


# --- ingestion ---------------------------------------------------------------


@query(
    "raw_append",
    """WITH e AS (SELECT user_id AS source_id, event_type AS external_id, sha256(props) AS content_hash, event_id AS ingest_pos, ts FROM events)
       SELECT source_id, external_id, content_hash, min(ingest_pos) AS ingest_pos FROM e WHERE ingest_pos % 2 = 1 AND NOT EXISTS (SELECT 1 FROM e o WHERE o.ingest_pos % 2 = 0 AND o.source_id = e.source_id AND o.external_id = e.external_id AND o.content_hash = e.content_hash) GROUP BY ALL""",
)
def raw_append(t):
    e = t("events").select(F.col("user_id").alias("source_id"), F.col("event_type").alias("external_id"), F.sha2("props", 256).alias("content_hash"), F.col("event_id").alias("ingest_pos"))
    return ingest.new_documents(e.filter("ingest_pos % 2 = 0"), e.filter("ingest_pos % 2 = 1"))


@query("item_problems", "SELECT CASE WHEN event_id % 7 = 0 THEN 'id' WHEN event_id % 7 = 1 THEN 'url' WHEN event_id % 7 = 2 THEN 'payload' END AS problem, count(*) AS n FROM events GROUP BY 1")
def item_problems(t):
    k = F.col("event_id") % 7
    problem = ingest.item_problem(F.when(k != 0, F.col("event_id").cast("string")).otherwise(""), F.when(k == 1, "http://x").otherwise("https://x"), F.when(k != 2, F.col("props")))
    return t("events").groupBy(problem.alias("problem")).agg(F.count("*").alias("n"))


@query("run_counters", "SELECT user_id AS run_id, count(*) AS fetched, count(*) FILTER (WHERE event_id % 3 = 0) AS unchanged, count(*) FILTER (WHERE event_id % 3 = 1) AS failed, count(*) FILTER (WHERE event_id % 3 = 2) AS stored FROM events GROUP BY user_id")
def run_counters(t):
    k = F.col("event_id") % 3
    return ingest.run_counters(t("events").select(F.col("user_id").alias("run_id"), F.when(k == 0, "unchanged").when(k == 1, "failed").otherwise("stored").alias("outcome")))


_EVENT_NOW = "TIMESTAMP '2024-01-15 12:00:00'"


@query("stale_reaper", f"SELECT event_id, CASE WHEN event_id % 2 = 0 AND ts < {_EVENT_NOW} - INTERVAL 1 HOUR THEN 'FAILED' WHEN event_id % 2 = 0 THEN 'RUNNING' ELSE 'SUCCESS' END AS status, event_id % 2 = 0 AND ts < {_EVENT_NOW} - INTERVAL 1 HOUR AS reaped FROM events")
def stale_reaper(t):
    runs = t("events").select("event_id", F.col("user_id").cast("string").alias("source_id"), F.when(F.col("event_id") % 2 == 0, "RUNNING").otherwise("SUCCESS").alias("status"), F.col("ts").alias("started_at"), F.lit(None).cast("timestamp_ntz").alias("finished_at"), F.lit(None).cast("string").alias("error_message"))
    return ingest.reap(runs, F.expr("timestamp_ntz'2024-01-15 12:00:00'")).select("event_id", "status", "reaped")


@query(
    "since_take_while",
    """WITH e AS (SELECT user_id, event_id, ts FROM events), s AS (SELECT user_id, min(event_id) AS stop FROM e WHERE ts < (SELECT min(ts) + INTERVAL 1 DAY FROM events) AND event_id % 4 = 3 GROUP BY user_id)
       SELECT e.user_id, event_id FROM e LEFT JOIN s ON e.user_id = s.user_id WHERE stop IS NULL OR event_id < stop""",
)
def since_take_while(t):
    floor = t("events").agg((F.min("ts") + F.expr("INTERVAL 1 DAY")).alias("floor"))
    e = t("events").join(F.broadcast(floor)).select("user_id", "event_id", F.when(F.col("event_id") % 4 == 3, F.col("ts")).alias("at"), "floor")
    return ingest.scan(e, "event_id", "at", since=F.col("floor"), recent_first=True, source="user_id").select("user_id", "event_id")


@query("since_filter", "SELECT event_id FROM events WHERE event_id < 100 * 20 AND (event_id % 5 = 0 OR value >= 50) ORDER BY event_id LIMIT 500")
def since_filter(t):
    e = t("events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("at"))
    return ingest.scan(e, "event_id", "at", since=F.lit(50.0), limit=500, page_size=20, max_pages=100).select("event_id")


@query("retention", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 5 DAY")
def retention(t):
    newest = t("events").agg(F.max("ts").alias("now"))
    return ingest.retained(t("events").join(F.broadcast(newest)).withColumn("fetched_at", F.col("ts")), F.col("now"), 5).select("event_id")


@query("job_activity", "SELECT l_orderkey AS job_id, bool_or(l_linestatus = 'O') AS is_active FROM lineitem GROUP BY 1")
def job_activity(t):
    return ingest.job_activity(t("lineitem").select(F.col("l_orderkey").alias("job_id"), (F.col("l_linestatus") == "O").alias("is_active")))


@query("source_sync", "SELECT s_name AS key, CASE WHEN s_suppkey % 2 = 0 THEN upper(s_name) ELSE s_name END AS display_name, s_suppkey % 3 <> 0 AS enabled FROM supplier")
def source_sync(t):
    old = t("supplier").select(F.col("s_name").alias("key"), F.col("s_name").alias("display_name"), (F.col("s_suppkey") % 3 != 0).alias("enabled"))
    new = t("supplier").filter("s_suppkey % 2 = 0").select(F.col("s_name").alias("key"), F.upper("s_name").alias("display_name"))
    return ingest.sync_sources(old, new)


@query("incremental_since", "SELECT event_type AS source_id, max(ts) - INTERVAL 1 DAY AS since FROM events WHERE event_id % 2 = 0 GROUP BY 1")
def incremental_since(t):
    return ingest.since_floor(t("events").select(F.col("event_type").alias("source_id"), F.when(F.col("event_id") % 2 == 0, "SUCCESS").otherwise("FAILED").alias("status"), F.col("ts").alias("started_at")))


# --- classification ------------------------------------------------------------


@query(
    "experience_extract",
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size % 9 WHEN 1 THEN p_size % 9 WHEN 2 THEN p_size % 9 WHEN 3 THEN 5 END AS min_years, CASE p_partkey % 5 WHEN 0 THEN p_size % 9 + 2 END AS max_years FROM part""",
)
def experience_extract(t):
    k, n = F.col("p_partkey") % 5, F.col("p_size") % 9
    s = n.cast("string")
    said = F.when(k == 0, F.concat(s, F.lit("–"), (n + 2).cast("string"), F.lit(" years"))).when(k == 1, F.concat(s, F.lit("+ years"))).when(k == 2, F.concat(F.lit("mindestens "), s, F.lit(" Jahre Erfahrung"))).when(k == 3, "2+ years, at least 5 years in Java").otherwise("many years")
    return t("part").withColumn("y", classify.required_years(said)).select("p_partkey", "y.min_years", "y.max_years")


@query(
    "junior_score",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'EXPERIENCED' WHEN 1 THEN 'ENTRY_LEVEL' WHEN 2 THEN 'EXPERIENCED' ELSE 'AMBIGUOUS' END AS level, CASE p_partkey % 4 WHEN 0 THEN 27 WHEN 1 THEN 98 WHEN 2 THEN 22 ELSE 52 END AS score FROM part""",
)
def junior_score(t):
    k = F.col("p_partkey") % 4
    said = F.when(k == 0, "We ask for 4+ years").when(k == 1, "Entry level, graduates too").when(k == 2, "You lead a team").otherwise("A job")
    title = F.when(k < 2, "Junior developer").otherwise("Developer")
    told = t("part").select("p_partkey", title.alias("title"), classify.required_years(said)["min_years"].alias("years"), classify.signals(said, classify.POSITIVE).alias("p"), classify.signals(said, classify.NEGATIVE).alias("n"))
    weight = F.aggregate(F.concat("p", "n"), F.lit(0), lambda a, x: a + x["weight"])
    judged = told.select("p_partkey", classify.level(F.col("title"), F.col("years"), F.col("p"), F.col("n")).alias("level"), weight.alias("weight"))
    return judged.select("p_partkey", "level", classify.score(F.col("level"), F.col("weight")).alias("score"))


@query("signals_parse", "SELECT doc_id, quality + 1 AS n, 'q' || toxic AS code, CAST(quality AS DOUBLE) AS weight FROM labels")
def signals_parse(t):
    good = '{"code": "q%s", "weight": %s, "evidence": "e", "more": 1}'
    json = F.format_string("[" + good + ', {"code": 1, "weight": 1, "evidence": "x"}, 5, {"code": "c"}%s]', F.col("toxic"), F.col("quality"), F.when(F.col("quality") == 1, ', {"code": "z", "weight": 2.5, "evidence": ""}').otherwise(""))
    return t("labels").withColumn("s", classify.parse_signals(json)).select("doc_id", F.size("s").cast("long").alias("n"), F.get("s", F.lit(0))["code"].alias("code"), F.get("s", F.lit(0))["weight"].alias("weight"))


@query("fts_match")
def fts_match(t):
    null = F.lit(None).cast("string")
    rows = t("documents").withColumn("conf", text.search_configuration(text.detect_language(null, F.col("text"), null)))
    vectors = rows.withColumn("v", search.search_vector(F.lit("posting"), F.col("source"), F.col("text"), F.col("conf")))
    said = {"english": 'hering or "onthe erand" -stupid', "german": "enschach or keitver -dumm"}
    fits = F.when(F.col("conf") == "german", search.matches(F.col("v"), said["german"], "german")).otherwise(search.matches(F.col("v"), said["english"], "english"))
    score = F.when(F.col("conf") == "german", search.rank(F.col("v"), said["german"], "german")).otherwise(search.rank(F.col("v"), said["english"], "english"))
    return vectors.select("doc_id", "conf", fits.alias("fits"), F.round(score, 9).alias("rank"), F.size("v").alias("n_lexemes"))


# --- flagship: listing over resolved postings ----------------------------------


@query(
    "resolved_listing",
    f"""WITH p AS (SELECT doc_id, source, {sql_language('text')} AS language, sha256(coalesce(text, '') || '|' || {sql_language('text')}) AS h FROM documents),
        j AS (SELECT h, min(doc_id) AS job_id, count(*) AS n_postings, count(DISTINCT source) AS source_count, arg_min(language, doc_id) AS language FROM p GROUP BY h)
        SELECT job_id, n_postings, source_count, language FROM j ORDER BY source_count DESC, job_id DESC LIMIT 50""",
)
def resolved_listing(t):
    null = F.lit(None).cast("string")
    p = t("documents").withColumn("language", text.detect_language(null, F.col("text"), null)).select("doc_id", "source", "language", F.sha2(F.concat(F.coalesce("text", F.lit("")), F.lit("|"), "language"), 256).alias("h"))
    jobs = p.groupBy("h").agg(F.min("doc_id").alias("job_id"), F.count("*").alias("n_postings"), F.countDistinct("source").alias("source_count"), F.min_by("language", "doc_id").alias("language"))
    return jobs.select("job_id", "n_postings", "source_count", "language").orderBy(F.desc("source_count"), F.desc("job_id")).limit(50)


from . import writes  # noqa: E402, F401  adds its queries
