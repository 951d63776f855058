"""Registered queries over the given tables, one for each operator family, with the SQL that checks them.

Documents stand for repositories: a source is a repository, a document a file of it, its language the kind of file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.functions import arrays, binary, paths
from assayer.operators import anomaly, detectors, graph, lineage, metrics, rank, rules, similarity, verdict
from assayer.operators import patterns as P
from assayer.plans import samples
from assayer.sources import sinks
from assayer.sources.shared import checkpointed

QUERIES: dict = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt out to all cores where their source has fewer files than there are cores: a file with one row group is one task's work."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, path, content, doc_id of the documents, as files of their sources."""
    ext = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "de", ".json").when(F.col("lang") == "fr", ".js").otherwise(".txt")
    path = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), ext)
    return table(spark, sf_dir, "documents").select(F.col("source").alias("repo"), path.alias("path"), F.col("text").alias("content"), "doc_id")


def sample_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, path, content, doc_id of the documents, each with a piece of code after its text."""
    return samples.files(spread(table(spark, sf_dir, "documents")))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of those files with their repo (the path up to the slash)."""
    found = detectors.observations(sample_files(spark, sf_dir).select("path", "content"))
    return found.withColumn("repo", F.substring_index("path", "/", 1))


FILES_SQL = """files AS (
  SELECT doc_id, source AS repo, text AS content,
    source || '/' || doc_id || CASE lang WHEN 'en' THEN '.py' WHEN 'de' THEN '.json' WHEN 'fr' THEN '.js' ELSE '.txt' END AS path
  FROM documents
)"""
_API_KEY = P.API_KEY.replace('["\']', r"[\x22\x27]")
FINDINGS_SQL = samples.FINDINGS_SQL


# ------------------------------------------------------------------ scalars


@query("SELECT doc_id, sha256(text) AS sha256, sha1(text) AS sha1, md5(text) AS md5 FROM documents")
def content_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *binary.hashes(F.encode("text", "UTF-8")))


@query("SELECT sha256(text) AS sha256, substr(sha256(text), 1, 2) AS shard, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1, 2")
def content_dedup(spark, sf_dir):
    keyed = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return keyed.groupBy("sha256").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).withColumn("shard", F.substring("sha256", 1, 2))


@query(
    """SELECT doc_id, round(-sum(p * log2(p)), 6) AS entropy FROM (
         SELECT doc_id, count(*) / sum(count(*)) OVER (PARTITION BY doc_id) AS p
         FROM (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY doc_id, c) GROUP BY doc_id"""
)
def char_entropy(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text <> ''")
    return docs.select("doc_id", F.round(binary.text_entropy("text"), 6).alias("entropy"))


@query(r"SELECT page_id, len(r) AS n_runs, list_slice(r, 1, 256)[1] AS first_run, len(array_to_string(list_slice(r, 1, 256), '')) AS run_chars FROM (SELECT page_id, regexp_extract_all(html, '[\x20-\x7e]{4,}') AS r FROM pages)")
def ascii_runs(spark, sf_dir):
    runs = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract_all("html", F.lit(binary.PRINTABLE), 0).alias("r"))
    kept = F.slice("r", 1, binary.MAX_STRINGS)
    return runs.select("page_id", F.size("r").cast("long").alias("n_runs"), F.get(kept, F.lit(0)).alias("first_run"), F.length(F.array_join(kept, "")).cast("long").alias("run_chars"))


@query(
    """SELECT doc_id, CAST(i AS BIGINT) AS chunk, sha256(substr(text, i * 4096 + 1, 4096)) AS sha256
       FROM (SELECT doc_id, text, unnest(generate_series(0, (length(text) - 1) // 4096)) AS i FROM documents WHERE text <> '')"""
)
def chunk_hashes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text <> ''")
    last = F.expr("(length(text) - 1) div 4096")
    at = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk"))
    return at.select("doc_id", "chunk", F.sha2(F.expr("substring(text, CAST(chunk * 4096 + 1 AS int), 4096)"), 256).alias("sha256"))


@query(
    rf"""WITH {FILES_SQL} SELECT CASE WHEN path LIKE '%.py' OR path LIKE '%.js' THEN 'source' WHEN path LIKE '%.json' THEN 'config' ELSE 'unknown' END AS class,
       regexp_matches(path, '^test') AS in_test, count(*) AS n_files, CAST(sum(length(content)) AS BIGINT) AS chars FROM files GROUP BY 1, 2"""
)
def file_classes(spark, sf_dir):
    f = files(spark, sf_dir).withColumns({"class": paths.classify(F.col("path")), "in_test": paths.is_test_path(F.col("path"))})
    return f.groupBy("class", "in_test").agg(F.count("*").alias("n_files"), F.sum(F.length("content")).alias("chars"))


@query(
    """SELECT event_type, CASE WHEN s >= 0.95 THEN 'critical' WHEN s >= 0.9 THEN 'high' WHEN s >= 0.7 THEN 'medium' WHEN s >= 0.3 THEN 'low' END AS severity, count(*) AS n
       FROM (SELECT event_type, least(value / 100, 1.0) AS s FROM events) GROUP BY 1, 2"""
)
def classify_severity(spark, sf_dir):
    scored = table(spark, sf_dir, "events").select("event_type", F.least(F.col("value") / 100, F.lit(1.0)).alias("s"))
    return scored.groupBy("event_type", binary.score_severity(F.col("s")).alias("severity")).agg(F.count("*").alias("n"))


@query("SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def json_props(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.expr("try_variant_get(try_parse_json(props), '$.k', 'int')"))
    return e.groupBy("k", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


# ------------------------------------------------------------------ detectors


@query(rf"SELECT doc_id, n FROM (SELECT doc_id, CAST(len(regexp_extract_all(text, '{_API_KEY}')) AS BIGINT) AS n FROM documents) WHERE n > 0")
def secret_scan(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit(P.API_KEY)).cast("long").alias("n"))
    return found.filter("n > 0")


@query(
    r"""SELECT doc_id, ip, count(*) AS n,
         regexp_matches(ip, '^(127\.|0\.|10\.|192\.168\.|172\.16\.|172\.17\.|172\.18\.|172\.19\.|172\.2|172\.3|169\.254\.)') AS private
       FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}')) AS ip FROM documents) GROUP BY ALL"""
)
def ip_scan(spark, sf_dir):
    quads = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"), 0)).alias("ip"))
    return quads.groupBy("doc_id", "ip").agg(F.count("*").alias("n")).withColumn("private", paths.is_private_address(F.col("ip")))


@query(
    """SELECT doc_id, CAST(len(r) AS BIGINT) AS n, list_max(list_transform(r, lambda x: len(x))) AS longest
       FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9+/]{40,}={0,2}') AS r FROM documents) WHERE len(r) > 0"""
)
def base64_runs(spark, sf_dir):
    runs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(P.BASE64), 0).alias("r")).filter(F.size("r") > 0)
    return runs.select("doc_id", F.size("r").cast("long").alias("n"), F.array_max(F.transform("r", lambda x: F.length(x))).cast("long").alias("longest"))


@query(
    """WITH needles AS (SELECT unnest(['powershell', 'cmd.exe', 'http://', 'https://', 'socket', 'curl', 'dlopen', 'ptrace', 'mach_vm_write', '<script>', 'track(', 'href=']) AS needle)
       SELECT page_id, needle, place FROM (
         SELECT page_id, needle, CAST(unnest(list_filter(generate_series(0, length(html) - 1), lambda i: substr(lower(html), i + 1, length(needle)) = needle)) AS BIGINT) AS place
         FROM pages JOIN needles ON contains(lower(html), needle))
       UNION ALL SELECT page_id, needle, instr(html, needle) - 1 FROM pages
         JOIN (SELECT unnest(['CreateRemoteThread', 'WriteProcessMemory', 'VirtualAlloc', 'NtMapViewOfSection', 'LoadLibrary', 'WinExec', 'ShellExecute']) AS needle) ON contains(html, needle)"""
)
def needle_offsets(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"))
    markup = (("<script>", "script"), ("track(", "script"), ("href=", "link"))
    return rules.needle_offsets(pages, P.NEEDLES + markup).select("page_id", "needle", F.col("at").cast("long").alias("place"))


_WORDS = ((("href=", "<article>"), "linked_article", "medium"), (("<!-- ad", "script"), "tracked_ad", "high"), (("<table", "href="), "linked_table", "low"))


@query(
    """SELECT page_id, capability, severity FROM pages JOIN (VALUES ('href=', '<article>', 'linked_article', 'medium'), ('<!-- ad', 'script', 'tracked_ad', 'high'), ('<table', 'href=', 'linked_table', 'low'))
       AS t(a, b, capability, severity) ON contains(html, a) AND contains(html, b)"""
)
def all_of_capabilities(spark, sf_dir):
    return rules.capabilities(table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text")), _WORDS)


_PAGE_RULES = (rules.Rule("Layout", "layout", "low", ("<nav>", "<ul>", "<table", "class=\"ad\""), 3), rules.Rule("Linked", "link", "medium", ("SCRIPT", "track("), 1, regex="https?://", nocase=("SCRIPT",)))


@query(
    """SELECT page_id, 'Layout' AS rule, 'layout' AS category, 'low' AS severity, n AS n_strings FROM (SELECT page_id, contains(html, '<nav>')::INT + contains(html, '<ul>')::INT + contains(html, '<table')::INT + contains(html, 'class="ad"')::INT AS n FROM pages) WHERE n >= 3
       UNION ALL SELECT page_id, 'Linked', 'link', 'medium', n FROM (SELECT page_id, html, contains(lower(html), 'script')::INT + contains(html, 'track(')::INT AS n FROM pages) WHERE n >= 1 AND regexp_matches(html, 'https?://')"""
)
def rule_n_of(spark, sf_dir):
    return rules.matches(table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text")), _PAGE_RULES)


_PLACED = {"secret:api_key": P.API_KEY, "crypto:eth_addr": P.ETH, "payload:shellcode": P.SHELLCODE, "obfuscation:js_obfusc": P.JS_OBFUSC, "payload:data_uri": P.DATA_URI}


@query(
    f"""WITH {samples.FILES_SQL}, looked AS (SELECT path, content, unnest([{", ".join(f"{{'category': '{c}', 'hits': regexp_extract_all(content, {samples.quoted(p)}), 'gaps': string_split_regex(content, {samples.quoted(p)})}}" for c, p in _PLACED.items())}]) AS x FROM files),
      hits AS (SELECT path, content, x, unnest(range(1, least(len(x.hits), 5) + 1)) AS i FROM looked),
      placed AS (SELECT path, x.category AS category, i, content, length(x.hits[i]) AS size, CAST(list_sum(list_transform(x.gaps[:i], lambda g: length(g))) + coalesce(list_sum(list_transform(x.hits[:i - 1], lambda h: length(h))), 0) AS BIGINT) AS start FROM hits),
      shown AS (SELECT *, left(content, start) AS before FROM placed)
    SELECT path, category, i AS nth, start, 1 + length(before) - length(replace(before, chr(10), '')) AS line, 1 + length(string_split(before, chr(10))[-1]) AS "column" FROM shown"""
)
def finding_places(spark, sf_dir):
    """Where the first matches of five detectors are in all files; the SQL finds lines and columns from the text before each match."""
    found = detectors.observations(sample_files(spark, sf_dir).select("path", "content"), evidence=True).filter(F.col("category").isin(*_PLACED))
    rows = found.select("path", "category", F.posexplode("places").alias("nth", "p"))
    return rows.select("path", "category", (F.col("nth") + 1).cast("long").alias("nth"), *[F.col(f"p.{c}").cast("long").alias(c) for c in ("start", "line", "column")])


@query(
    f"""WITH {samples.FILES_SQL}, urls AS (SELECT path, content, unnest(regexp_extract_all(content, {samples.quoted(P.HARDCODED_IP)}, 1)) AS url FROM files)
    SELECT path, 'http' AS kind, url AS value, count(*) AS n FROM urls WHERE url NOT LIKE 'http://10.%' GROUP BY ALL
    UNION ALL SELECT path, 'eval', list_distinct(regexp_extract_all(content, '(?:eval|exec)\\s*\\('))[1], 1 FROM files WHERE path LIKE '%/a.py' OR path LIKE '%/j.js'"""
)
def finding_values(spark, sf_dir):
    """What findings quote: each public address on its own, and the call of files whose snippet has one."""
    found = detectors.observations(sample_files(spark, sf_dir).select("path", "content"), evidence=True)
    urls = found.filter("category IN ('import:hardcoded_ip', 'import:cloud_metadata') AND size(values) = 1 AND values[0] NOT LIKE 'http://10.%'").select("path", F.lit("http").alias("kind"), F.get("values", F.lit(0)).alias("value"))
    calls = found.filter("category = 'obfuscation:eval_exec' AND (path LIKE '%/a.py' OR path LIKE '%/j.js')").select("path", F.lit("eval").alias("kind"), F.get("values", F.lit(0)).alias("value"))
    return urls.unionByName(calls).groupBy("path", "kind", "value").agg(F.count("*").alias("n"))


@query(f"WITH {FINDINGS_SQL} SELECT category, severity, count(*) AS n_files, CAST(sum(hits) AS BIGINT) AS hits FROM found GROUP BY 1, 2")
def detector_rollup(spark, sf_dir):
    return findings(spark, sf_dir).groupBy("category", "severity").agg(F.count("*").alias("n_files"), F.sum("hits").alias("hits"))


# ------------------------------------------------------------------ verdicts and ranks

_LADDER = """SELECT repo, n_high, n_medium, n_vectors, n_findings,
  CASE WHEN n_high > 0 OR (n_medium >= 3 AND n_vectors >= 3) THEN 'malicious' WHEN n_medium > 0 THEN 'suspicious' WHEN n_findings > 0 THEN 'inconclusive' ELSE 'clean' END AS state
  FROM (SELECT f.repo, count(*) FILTER (severity IN ('high', 'critical')) AS n_high, count(*) FILTER (severity = 'medium') AS n_medium,
    count(DISTINCT split_part(category, ':', 1)) FILTER (severity = 'medium') AS n_vectors, count(category) AS n_findings
    FROM (SELECT DISTINCT repo FROM files) f LEFT JOIN found ON f.repo = found.repo GROUP BY f.repo)"""


@query(f"WITH {FINDINGS_SQL} {_LADDER}")
def verdict_by_group(spark, sf_dir):
    return verdict.repository_verdicts(findings(spark, sf_dir), "repo", sample_files(spark, sf_dir)).drop("reasons")


_CHAINED = "n_medium >= 3 AND n_vectors >= 3"
_MEDIUM_SQL = "n_medium || ' findings of medium severity'"


@query(
    f"""WITH {FINDINGS_SQL}, tallied AS (SELECT repo, count(*) FILTER (severity IN ('high', 'critical')) AS n_high, count(*) FILTER (severity = 'medium') AS n_medium, count(*) AS n_findings,
        list_sort(list(DISTINCT split_part(category, ':', 1)) FILTER (severity = 'medium' AND split_part(category, ':', 1) NOT IN ({", ".join(map(repr, P.NON_ATTACK_PREFIXES))}))) AS vectors FROM found GROUP BY 1),
      binaries AS (SELECT source || '-' || (doc_id % {samples.REPOSITORIES}) AS repo, count(*) FILTER (toxic = 1) AS bad, count(*) FILTER (toxic = 0 AND quality = 0) AS odd FROM labels JOIN documents USING (doc_id) GROUP BY 1),
      joined AS (SELECT repo, coalesce(n_high, 0) AS n_high, coalesce(n_medium, 0) AS n_medium, coalesce(n_findings, 0) AS n_findings, coalesce(bad, 0) AS bad, coalesce(odd, 0) AS odd, vectors, coalesce(len(vectors), 0) AS n_vectors
        FROM (SELECT DISTINCT repo FROM files) LEFT JOIN tallied USING (repo) LEFT JOIN binaries USING (repo))
    SELECT repo, CASE WHEN n_high > 0 OR bad > 0 OR ({_CHAINED}) THEN 'malicious' WHEN n_medium > 0 OR odd > 0 THEN 'suspicious' WHEN n_findings > 0 THEN 'inconclusive' ELSE 'clean' END AS state,
      CASE WHEN n_high > 0 OR bad > 0 THEN list_filter([CASE WHEN n_high > 0 THEN n_high || ' findings of high severity' END, CASE WHEN bad > 0 THEN bad || ' malicious binaries' END], lambda x: x IS NOT NULL)
        WHEN {_CHAINED} THEN [{_MEDIUM_SQL} || ' over ' || n_vectors || ' kinds of attack: ' || array_to_string(vectors, ', ')]
        WHEN n_medium > 0 OR odd > 0 THEN list_filter([CASE WHEN n_medium > 0 THEN {_MEDIUM_SQL} END, CASE WHEN odd > 0 THEN odd || ' suspicious binaries' END], lambda x: x IS NOT NULL)
        WHEN n_findings > 0 THEN ['only weak findings'] ELSE ['nothing found'] END AS reasons FROM joined"""
)
def repository_reasons(spark, sf_dir):
    """Verdicts of repositories that hold binaries too (labelled documents: toxic ones malicious, bad ones suspicious), and why."""
    repo = F.concat("source", F.lit("-"), (F.col("doc_id") % samples.REPOSITORIES).cast("string"))
    labelled = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    binaries = labelled.select(repo.alias("repo"), F.when(F.col("toxic") == 1, "malicious").when((F.col("toxic") == 0) & (F.col("quality") == 0), "suspicious").otherwise("clean").alias("state"))
    return verdict.repository_verdicts(findings(spark, sf_dir), "repo", sample_files(spark, sf_dir), binaries).select("repo", "state", "reasons")


@query(
    """WITH severities AS (SELECT date_trunc('day', ts) AS submission, user_id,
           CASE WHEN value >= 300 THEN 'high' WHEN value >= 20 THEN 'medium' ELSE 'info' END AS severity,
           CASE WHEN event_type = 'purchase' AND value < 1 THEN 'coverage_gap' ELSE event_type || ':x' END AS category FROM events),
       counts AS (SELECT submission, count(*) FILTER (severity = 'high') AS n_high, count(*) FILTER (severity = 'medium') AS n_medium,
           count(DISTINCT split_part(category, ':', 1)) FILTER (severity = 'medium') AS n_vectors, count(*) AS n_findings, bool_or(category = 'coverage_gap') AS gap FROM severities GROUP BY 1)
       SELECT CAST(submission AS DATE) AS day, n_high, n_medium, n_vectors, n_findings,
         CASE WHEN n_high > 0 OR (n_medium >= 3 AND n_vectors >= 3) THEN 'malicious'
              WHEN day(submission) % 2 = 0 AND NOT gap THEN 'clean'
              WHEN n_medium > 0 OR day(submission) % 2 = 1 THEN CASE WHEN day(submission) % 2 = 1 AND n_medium = 0 THEN 'inconclusive' ELSE 'suspicious' END ELSE 'inconclusive' END AS state
       FROM counts"""
)
def submission_verdicts(spark, sf_dir):
    return verdict.submission_verdicts(*_submissions(spark, sf_dir)).select(F.col("submission").alias("day"), "state", "n_high", "n_medium", "n_vectors", "n_findings")


def _submissions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    found = e.select(
        F.to_date("ts").alias("submission"),
        F.when(F.col("value") >= 300, "high").when(F.col("value") >= 20, "medium").otherwise("info").alias("severity"),
        F.when((F.col("event_type") == "purchase") & (F.col("value") < 1), "coverage_gap").otherwise(F.concat("event_type", F.lit(":x"))).alias("category"),
    )
    even = F.dayofmonth("submission") % 2 == 0
    roots = found.select("submission").distinct().select(
        "submission", even.alias("trusted"), F.when(even, "b").alias("baseline_id"), even.alias("matched"), F.when(even, 0.1).otherwise(1.0).alias("distance"), F.lit(False).alias("dynamic_gap")
    )
    return found, roots


@query(
    """WITH found AS (SELECT CAST(ts AS DATE) AS day, CASE WHEN value >= 300 THEN 'high' WHEN value >= 20 THEN 'medium' ELSE 'info' END AS severity, event_type, event_type = 'purchase' AND value < 1 AS gap FROM events),
      c AS (SELECT day, day(day) % 2 = 0 AS good, count(*) FILTER (severity = 'high') AS h, count(*) FILTER (severity = 'medium') AS m, bool_or(gap) AS gap,
        list_sort(list(DISTINCT event_type) FILTER (severity = 'medium' AND NOT gap)) AS v FROM found GROUP BY 1)
    SELECT day, CASE WHEN NOT good AND h = 0 AND m = 0 THEN ['neither trusted provenance nor a baseline'] WHEN good AND NOT gap AND h = 0 AND NOT (m >= 3 AND len(v) >= 3) THEN ['trusted provenance and a matching baseline, nothing left open']
        WHEN h > 0 THEN [h || ' findings of high severity'] WHEN m >= 3 AND len(v) >= 3 THEN [m || ' findings of medium severity over ' || len(v) || ' kinds of attack: ' || array_to_string(v, ', ')]
        WHEN m > 0 OR NOT good THEN list_filter([CASE WHEN m > 0 THEN m || ' findings of medium severity' END, CASE WHEN NOT good THEN 'far from every baseline' END], lambda x: x IS NOT NULL) ELSE [] END AS reasons FROM c"""
)
def submission_reasons(spark, sf_dir):
    """Why each day's submission has its verdict."""
    return verdict.submission_verdicts(*_submissions(spark, sf_dir)).select(F.col("submission").alias("day"), "reasons")


@query(
    """WITH RECURSIVE links AS (SELECT 'c' || o_custkey AS parent, 'o' || o_orderkey AS child FROM orders UNION SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem UNION SELECT 'p' || p_partkey, p_brand FROM part
        UNION SELECT p_brand, 'm' || right(p_brand, 1) FROM part UNION SELECT 'm' || right(p_brand, 1), p_brand FROM part),
      walk AS (SELECT DISTINCT 'c' || o_custkey AS root, 'c' || o_custkey AS content, 0 AS depth FROM orders UNION SELECT root, child, depth + 1 FROM walk JOIN links ON parent = content WHERE depth < 8)
    SELECT root, content, min(depth) AS depth FROM walk GROUP BY 1, 2"""
)
def lineage_reach(spark, sf_dir):
    """What every customer holds through orders, parts and brands, which lie in each other in a cycle."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    o, l, p = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part"))
    maker = F.concat(F.lit("m"), F.right("p_brand", F.lit(1)))
    pairs = [o.select(name("c", "o_custkey"), name("o", "o_orderkey")), l.select(name("o", "l_orderkey"), name("p", "l_partkey")), p.select(name("p", "p_partkey"), "p_brand"), p.select("p_brand", maker), p.select(maker, "p_brand")]
    edges = pairs[0].toDF("parent", "child")
    for more in pairs[1:]:
        edges = edges.union(more)
    return lineage.reached(o.select(name("c", "o_custkey").alias("root")), edges, depth=8)


@query(
    """SELECT user_id, n_medium, n_vectors, n_medium >= 3 AND n_vectors >= 3 AS compound FROM (
         SELECT user_id, count(*) FILTER (value >= 50) AS n_medium, count(DISTINCT event_type) FILTER (value >= 50 AND event_type NOT IN ('llm', 'ast')) AS n_vectors FROM events GROUP BY 1)"""
)
def compound_chain(spark, sf_dir):
    found = table(spark, sf_dir, "events").select("user_id", F.when(F.col("value") >= 50, "medium").otherwise("info").alias("severity"), F.col("event_type").alias("category"))
    return found.groupBy("user_id").agg(*verdict.severity_counts()).select("user_id", "n_medium", "n_vectors", verdict.is_compound().alias("compound"))


@query(
    f"""WITH {FINDINGS_SQL} SELECT f.repo, count(DISTINCT f.path) AS n_files, count(DISTINCT g.path) AS n_flagged,
        {", ".join(f"count(*) FILTER (severity = '{k}') AS n_{k}" for k in P.SEVERITIES)}
        FROM files f LEFT JOIN found g ON f.path = g.path GROUP BY f.repo"""
)
def repo_statistics(spark, sf_dir):
    return verdict.statistics(sample_files(spark, sf_dir), findings(spark, sf_dir), "repo")


@query(
    f"""WITH {FINDINGS_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, path, place) AS rank FROM found)
        SELECT repo, path, category, severity, rank FROM ranked WHERE rank <= 20"""
)
def top_findings(spark, sf_dir):
    return verdict.top_findings(findings(spark, sf_dir), "repo", "path", "ordinal").select("repo", "path", "category", "severity", F.col("rank").cast("long").alias("rank"))


_CANDIDATES_SQL = """candidates AS (SELECT CAST(ts AS DATE) AS day, user_id AS path, event_id AS ordinal,
    CASE event_type WHEN 'error' THEN 105 WHEN 'purchase' THEN 90 WHEN 'signup' THEN 80 WHEN 'click' THEN 60 ELSE 50 END AS priority FROM events),
  best AS (SELECT day, path, max(priority) AS priority, min(ordinal) AS ordinal FROM candidates GROUP BY 1, 2),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY priority DESC, ordinal, path) AS rank FROM best)"""


def _ranked(spark, sf_dir):
    level = F.col("event_type")
    p = F.when(level == "error", 105).when(level == "purchase", 90).when(level == "signup", 80).when(level == "click", 60).otherwise(50)
    c = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.col("user_id").alias("path"), F.col("event_id").alias("ordinal"), p.alias("priority"))
    return verdict.targets(c, "day").withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_CANDIDATES_SQL} SELECT day, path, priority, ordinal, rank FROM ranked")
def target_priority(spark, sf_dir):
    return _ranked(spark, sf_dir)


@query(
    f"""WITH {_CANDIDATES_SQL} SELECT day, path, priority, ordinal, rank FROM ranked JOIN (SELECT day, count(*) AS n FROM best GROUP BY 1) USING (day)
        WHERE priority >= 105 OR rank <= greatest(10, least(n // 30, 25))"""
)
def capped_targets(spark, sf_dir):
    ranked = _ranked(spark, sf_dir)
    return verdict.capped_targets(ranked, ranked.groupBy("day").agg(F.count("*").alias("n_files")), "day")


@query(
    """SELECT p_partkey, arg_min(word, place) AS word FROM (SELECT p_partkey, p_name, unnest(['ring', 'widget', 'bolt', 'small', 'red', 'blue']) AS word, unnest([1, 2, 3, 4, 5, 6]) AS place FROM part)
       WHERE contains(p_name, word) GROUP BY 1"""
)
def first_match(spark, sf_dir):
    return rank.first_match(table(spark, sf_dir, "part"), "p_name", ("ring", "widget", "bolt", "small", "red", "blue")).select("p_partkey", F.col("match").alias("word"))


@query(
    """SELECT conv_id, turn, tokens, used, used <= 100 AS within FROM (SELECT conv_id, turn, length(text) // 4 AS tokens,
         CAST(sum(length(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM conversations)"""
)
def budget_running_total(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr("CAST(length(text) div 4 AS bigint)").alias("tokens"))
    return rank.budgeted(c, "conv_id", "turn", budget=100)


@query(
    """SELECT user_id, event_type, list(event_id ORDER BY event_id) FILTER (n <= 10) AS messages, greatest(count(*) - 10, 0) AS overflow
       FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) GROUP BY 1, 2"""
)
def grouped_findings(spark, sf_dir):
    return rank.grouped(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id", "event_id")


@query("SELECT date_trunc('day', ts)::DATE AS day, count(*) AS n, count(*) > 20 AS triage FROM events WHERE event_type = 'error' GROUP BY 1")
def triage_mode(spark, sf_dir):
    return rank.triage_mode(table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.to_date("ts").alias("day")), "day")


@query(
    r"""SELECT page_id, sha256(html) AS sha256, md5(html) AS md5, octet_length(encode(html)) AS size, 'unknown' AS format, len(list_slice(regexp_extract_all(html, '[\x20-\x7e]{4,}'), 1, 256)) AS n_strings,
        CAST(ceil(octet_length(encode(html)) / 4096.0) AS BIGINT) AS n_chunks FROM pages"""
)
def page_artifacts(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.encode("html", "UTF-8").alias("content"))
    a = binary.artifacts(pages)
    return a.select(F.col("path").cast("long").alias("page_id"), "sha256", "md5", "size", "format", F.size("strings").cast("long").alias("n_strings"), F.size("chunk_hashes").cast("long").alias("n_chunks"))


# ------------------------------------------------------------------ joins

_SHINGLES = "SELECT DISTINCT {id} AS id, list_aggregate(w[i : i + 2], 'string_agg', ' ') AS element FROM (SELECT {id}, w, unnest(generate_series(1, len(w) - 2)) AS i FROM (SELECT {id}, regexp_extract_all(lower(text), '[a-z]+') AS w FROM {table}) WHERE len(w) >= 3)"


@query(
    f"""WITH a AS ({_SHINGLES.format(id="doc_id", table="documents")}), b AS ({_SHINGLES.format(id="item_id", table="benchmark")}),
       na AS (SELECT id, count(*) AS n FROM a GROUP BY 1), nb AS (SELECT id, count(*) AS n FROM b GROUP BY 1),
       shared AS (SELECT a.id, b.id AS other, count(*) AS n FROM a JOIN b USING (element) GROUP BY 1, 2)
       SELECT s.id AS doc_id, arg_min(s.other, row(round(1.0::DOUBLE - s.n::DOUBLE / (na.n + nb.n - s.n), 6), s.other)) AS item_id, min(round(1.0::DOUBLE - s.n::DOUBLE / (na.n + nb.n - s.n), 6)) AS distance
       FROM shared s JOIN na ON s.id = na.id JOIN nb ON s.other = nb.id GROUP BY 1"""
)
def baseline_nearest(spark, sf_dir):
    def shingles(name, key):
        w = spread(table(spark, sf_dir, name).select(F.col(key).alias("id"), "text")).select("id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0).alias("w"))
        three = lambda ws: F.transform(F.slice(ws, 1, F.greatest(F.size(ws) - 2, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get(ws, i + 1), F.get(ws, i + 2)))
        return w.select("id", arrays.let(F.col("w"), three).alias("elements"))

    found = similarity.nearest_by_elements(shingles("documents", "doc_id"), shingles("benchmark", "item_id"))
    return found.select(F.col("id").alias("doc_id"), F.col("nearest").alias("item_id"), "distance")


@query("SELECT s_suppkey AS artifact, n_nationkey AS baseline FROM supplier JOIN nation ON s_nationkey = n_nationkey OR floor(s_acctbal / 2000) = n_regionkey")
def baseline_or_join(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("artifact"), F.col("s_nationkey").alias("product"), F.floor(F.col("s_acctbal") / 2000).alias("signer"))
    b = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("baseline"), F.col("n_nationkey").alias("product"), F.col("n_regionkey").alias("signer"))
    return similarity.candidates(a, b)


@query(
    """WITH tags AS (SELECT DISTINCT date_trunc('hour', ts) AS directory, user_id AS path, event_type AS capability FROM events),
       peers AS (SELECT directory, count(DISTINCT path) AS peers FROM tags GROUP BY 1 HAVING count(DISTINCT path) >= 3),
       usual AS (SELECT directory, capability FROM tags JOIN peers USING (directory) GROUP BY 1, 2, peers HAVING count(*) >= greatest(2, floor(peers * 0.2::DOUBLE))),
       scored AS (SELECT directory, path, count(*) AS n_capabilities, count(*) FILTER (u.capability IS NULL) AS n_unusual FROM tags t LEFT JOIN usual u USING (directory, capability) GROUP BY 1, 2)
       SELECT directory, path, n_unusual, n_capabilities, peers, round(n_unusual::DOUBLE / n_capabilities, 3) AS score,
         CASE WHEN round(n_unusual::DOUBLE / n_capabilities, 3) >= 0.7 THEN 'high' ELSE 'medium' END AS severity
       FROM scored JOIN peers USING (directory) WHERE n_unusual > 0"""
)
def dir_anomaly(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    tags = e.select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("directory"), F.col("user_id").alias("path"), F.col("event_type").alias("capability")).distinct()
    return anomaly.directory_anomalies(tags).select("directory", "path", "n_unusual", "n_capabilities", "peers", "score", "severity")


_HREF = r"""<a href="([^"]*)\""""


@query("SELECT page_id, target, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS target FROM pages) GROUP BY 1, 2")
def ref_edges(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(_HREF), 1)).alias("target"))
    return found.groupBy("page_id", "target").agg(F.count("*").alias("n"))


@query(
    """WITH known AS (SELECT DISTINCT word || suffix AS path FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM benchmark), (SELECT unnest(['.py', '.js']) AS suffix)),
       refs AS (SELECT DISTINCT 'site/' || page_id || '.js' AS path, './../' || lower(substr(target, 2)) AS target FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS target FROM pages) WHERE regexp_matches(target, '^/[A-Za-z]+$'))
       SELECT refs.path, target, substr(target, 6) || '.py' AS resolved FROM refs JOIN known ON known.path = substr(target, 6) || '.py'"""
)
def ref_resolve(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), 0)).alias("w"))
    known = words.select(F.explode(F.array(F.concat("w", F.lit(".py")), F.concat("w", F.lit(".js")))).alias("path")).distinct()
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(_HREF), 1)).alias("t")).filter(F.col("t").rlike("^/[A-Za-z]+$"))
    refs = links.select(F.concat(F.lit("site/"), F.col("page_id").cast("string"), F.lit(".js")).alias("path"), F.concat(F.lit("./../"), F.lower(F.substring("t", 2, 1 << 20))).alias("target"), F.lit("import").alias("kind")).distinct()
    return graph.resolve(refs, known).select("path", "target", "resolved")


def _edges(spark, sf_dir):
    """Orders refer to parts, customers to orders."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    return l.select(name("o", "l_orderkey").alias("src"), name("p", "l_partkey").alias("dst")).unionByName(o.select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst")))


def _sides(spark, sf_dir):
    data = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"))
    big = table(spark, sf_dir, "orders").filter("o_totalprice > 200000").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("path"))
    low = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("path"))
    return data, big.unionByName(low)


_LEADS_SQL = """edges AS (SELECT DISTINCT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem UNION SELECT DISTINCT 'c' || o_custkey, 'o' || o_orderkey FROM orders),
  data AS (SELECT 'p' || p_partkey AS path FROM part),
  execs AS (SELECT 'o' || o_orderkey AS path FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT 'c' || c_custkey FROM customer WHERE c_acctbal < 0),
  reach AS (SELECT e.dst AS data_file, e.src AS exec_file, 1 AS depth FROM edges e JOIN data d ON e.dst = d.path
            UNION ALL SELECT e.dst, f.src, 2 FROM edges e JOIN data d ON e.dst = d.path JOIN edges f ON f.dst = e.src),
  leads AS (SELECT data_file, exec_file, min(depth) AS depth FROM reach JOIN execs ON exec_file = path GROUP BY 1, 2)"""


@query(f"WITH {_LEADS_SQL} SELECT data_file, exec_file, depth, CASE depth WHEN 1 THEN 'high' ELSE 'medium' END AS severity FROM leads")
def two_hop_leads(spark, sf_dir):
    return graph.leads(_edges(spark, sf_dir), *_sides(spark, sf_dir))


@query(
    f"""WITH {_LEADS_SQL} SELECT data_file, exec_file, depth,
        CASE WHEN depth = 1 AND count(*) OVER (PARTITION BY data_file) <= 20 THEN 'high' ELSE 'medium' END AS severity FROM leads"""
)
def lead_gate(spark, sf_dir):
    return graph.gated(graph.leads(_edges(spark, sf_dir), *_sides(spark, sf_dir)), "data_file")


@query(
    """WITH edges AS (SELECT DISTINCT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem),
       a AS (SELECT 'p' || p_partkey AS path FROM part WHERE p_size > 25), b AS (SELECT 'p' || p_partkey AS path FROM part WHERE p_size <= 25)
       SELECT x.dst AS data_file, y.dst AS exec_file, list_slice(list_sort(list(DISTINCT x.src)), 1, 3) AS importers
       FROM edges x JOIN a ON x.dst = a.path JOIN edges y ON x.src = y.src JOIN b ON y.dst = b.path GROUP BY 1, 2"""
)
def sibling_leads(spark, sf_dir):
    side = lambda large: table(spark, sf_dir, "part").filter((F.col("p_size") > 25) == large).select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"))
    return graph.sibling_leads(_edges(spark, sf_dir).filter("src LIKE 'o%'"), side(True), side(False))


@query("SELECT d.doc_id, coalesce(CASE WHEN l.toxic = 1 THEN 'toxic' WHEN l.doc_id IS NOT NULL THEN 'ok' END, 'missing') AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def status_left_join(spark, sf_dir):
    l = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise("ok").alias("status"))
    return metrics.joined(table(spark, sf_dir, "documents").select("doc_id"), l, ["doc_id"])


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_new(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return sinks.new_rows(docs, table(spark, sf_dir, "labels").select("doc_id"), ["doc_id"])


@query("SELECT c.conv_id, c.turn, c.role, p.role AS parent_role, length(p.text) AS parent_chars FROM conversations c LEFT JOIN conversations p ON c.conv_id = p.conv_id AND c.turn = p.turn + 1")
def turn_lineage(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    p = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("parent_role"), F.length("text").cast("long").alias("parent_chars"))
    return c.select("conv_id", "turn", "role").join(p, ["conv_id", "turn"], "left")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def upsert_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    half = F.col("event_type").isin("click", "view")
    return sinks.upserted(e.filter(half), e.filter(~half), ["user_id"], "event_id")


# ------------------------------------------------------------------ evaluation


@query(
    f"""WITH {FINDINGS_SQL}, judged AS (SELECT l.quality = 0 AS label, coalesce(n, 0) > 0 AS verdict FROM labels l JOIN files f USING (doc_id) LEFT JOIN (SELECT path, count(*) FILTER (severity = 'medium') AS n FROM found GROUP BY 1) g USING (path)),
        c AS (SELECT count(*) FILTER (label AND verdict) AS tp, count(*) FILTER (NOT label AND verdict) AS fp, count(*) FILTER (NOT label AND NOT verdict) AS tn, count(*) FILTER (label AND NOT verdict) AS fn FROM judged)
        SELECT tp, fp, tn, fn, CASE WHEN tp + fp + tn + fn = 0 THEN 0.0 ELSE round((tp + tn)::DOUBLE / (tp + fp + tn + fn), 4) END AS accuracy,
          CASE WHEN tp + fp = 0 THEN 0.0 ELSE round(tp::DOUBLE / (tp + fp), 4) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE round(tp::DOUBLE / (tp + fn), 4) END AS recall,
          CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE round((2 * tp)::DOUBLE / (2 * tp + fp + fn), 4) END AS f1 FROM c"""
)
def confusion_matrix(spark, sf_dir):
    flagged = findings(spark, sf_dir).groupBy("path").agg(F.count_if(F.col("severity") == "medium").alias("n"))
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).alias("label"))
    judged = labels.join(sample_files(spark, sf_dir).select("doc_id", "path"), "doc_id").join(flagged, "path", "left")
    return metrics.confusion(judged.select("label", (F.coalesce("n", F.lit(0)) > 0).alias("verdict")))


@query(
    f"""WITH {FINDINGS_SQL} SELECT split_part(category, ':', 1) AS source, count(*) AS n FROM found WHERE severity = 'medium' AND repo IN (SELECT repo FROM found GROUP BY 1 HAVING count(*) FILTER (severity = 'medium') >= 1)
        GROUP BY 1 ORDER BY n DESC, source LIMIT 10"""
)
def tool_contributions(spark, sf_dir):
    f = findings(spark, sf_dir).select(F.col("repo").alias("submission"), verdict.prefix(F.col("category")).alias("source"), F.when(F.col("severity") == "medium", "high").otherwise("info").alias("severity"))
    return metrics.contributions(f, f.filter("severity = 'high'"))


@query(
    f"""WITH {FINDINGS_SQL}, judged AS (SELECT CASE WHEN l.quality = 0 THEN 'malicious' ELSE 'clean' END AS expected, CASE WHEN coalesce(n, 0) > 0 THEN 'malicious' ELSE 'clean' END AS verdict
          FROM labels l JOIN files f USING (doc_id) LEFT JOIN (SELECT path, count(*) FILTER (severity = 'medium') AS n FROM found GROUP BY 1) g USING (path)),
        c AS (SELECT count(*) AS n_cases, count(*) FILTER (expected = verdict) AS n_passed, count(*) FILTER (expected = 'malicious' AND verdict = 'malicious') AS tp,
          count(*) FILTER (expected = 'malicious' AND verdict = 'clean') AS fn, count(*) FILTER (expected = 'clean' AND verdict = 'malicious') AS fp, count(*) FILTER (expected = 'clean' AND verdict = 'clean') AS tn FROM judged)
        SELECT *, CASE WHEN tp + fn = 0 THEN 0.0 ELSE round(tp::DOUBLE / (tp + fn), 4) END AS detection_rate, CASE WHEN fp + tn = 0 THEN 0.0 ELSE round(fp::DOUBLE / (fp + tn), 4) END AS false_positive_rate FROM c"""
)
def case_rates(spark, sf_dir):
    flagged = findings(spark, sf_dir).groupBy("path").agg(F.count_if(F.col("severity") == "medium").alias("n"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 0, "malicious").otherwise("clean").alias("expected"))
    judged = labels.join(sample_files(spark, sf_dir).select("doc_id", "path"), "doc_id").join(flagged, "path", "left")
    return metrics.case_rates(metrics.case_results(judged.select("expected", F.when(F.coalesce("n", F.lit(0)) > 0, "malicious").otherwise("clean").alias("verdict"))))


@query()
def typosquat(spark, sf_dir):
    """Words of documents that look like a popular package (similarity by matching blocks has no SQL form)."""
    from assayer.operators import dependencies

    words = spread(table(spark, sf_dir, "documents").select("text")).select(F.explode(F.array_distinct(F.split(F.lower("text"), r"[^a-z]+"))).alias("name")).filter("name <> ''")
    # Names are compared behind a checkpoint: the comparison would be pushed down to every word of every document.
    return dependencies.typosquats(checkpointed(words.groupBy("name").agg(F.count("*").alias("n_docs"))), P.POPULAR_NODE)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def hourly_events(spark, sf_dir):
    """Tumbling windows over events; the streaming form with a watermark is in assayer.streaming."""
    from assayer.streaming import inbox

    out = inbox.hourly(table(spark, sf_dir, "events"))
    return out.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
