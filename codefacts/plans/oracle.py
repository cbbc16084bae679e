"""The engine's operators on the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codefacts.functions import sets, text
from codefacts.operators import checks, facts, fold, hierarchy, relational, reports, symbols
from codefacts.plans import lint
from codefacts.session import cut

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.explode(F.split("text", "\n", -1)).alias("line"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents)
SELECT doc_id, line_no::INT AS line_no, md5(x) AS line_md5,
  coalesce(sum(strlen(x) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_pos
FROM l""")
def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lines and their byte offsets, inside the row."""
    d = read(spark, sf_dir, "documents")
    return text.lines(d, "text", "doc_id").select("doc_id", "line_no", F.md5("text").alias("line_md5"), "byte_pos")


@query("""
SELECT page_id, url, regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/]\\.([A-Za-z0-9]+)$', 1) AS ext FROM pages
WHERE NOT regexp_matches(url, '^https?://blog\\.') AND regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/]\\.([A-Za-z0-9]+)$', 1) IN ('html', 'php')""")
def extension_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension and exclude filters; both are column expressions over one scan."""
    p = read(spark, sf_dir, "pages").withColumn("ext", text.extension(F.col("url")))
    return p.where(F.col("ext").isin("html", "php") & ~F.col("url").rlike(r"^https?://blog\.")).select("page_id", "url", "ext")


@query("""
SELECT page_id, CASE
  WHEN regexp_matches(p, '^(?:/en/.*/archive)(/|$)') THEN true
  WHEN regexp_matches(p, '^(?:/fr)(/|$)') OR regexp_matches(p, '^(?:/de)(/|$)') THEN false ELSE true END AS enabled
FROM (SELECT page_id, regexp_replace(url, '^https?://[^/]*', '') AS p FROM pages)""")
def path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the deepest matching rule decides."""
    p = read(spark, sf_dir, "pages").withColumn("p", F.regexp_replace("url", "^https?://[^/]*", ""))
    return p.select("page_id", reports.path_rules(p, "p", [("/fr", False), ("/de", False), ("/en/*/archive", True)]).alias("enabled"))


@query("""
SELECT source, lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n = 1""")
def keep_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: of the rows with one key the longest, by one aggregation."""
    d = read(spark, sf_dir, "documents").select("source", "lang", "doc_id", "n_chars")
    return symbols.keep_longest(d, ["source", "lang"], "n_chars", "doc_id")


@query("""
SELECT user_id, max_by(value, (ts, event_id)) AS last_value FROM (SELECT user_id, value, ts, event_id FROM events) GROUP BY user_id""".replace("max_by(value, (ts, event_id))", "arg_max(value, (ts, event_id))"))
def last_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: the last write of each key."""
    return symbols.last_writer(read(spark, sf_dir, "events"), ["user_id"], F.col("value"), F.struct("ts", "event_id"), "last_value")


@query("""
WITH s AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS t, list_sort(list_distinct(list(event_type) FILTER (WHERE value > 50))) AS h FROM events GROUP BY user_id)
SELECT user_id, array_to_string(t, '|') AS types, array_to_string(list_sort(list_intersect(t, coalesce(h, []))), '|') AS high_types,
  array_to_string(list_sort(list_filter(t, lambda x: NOT list_contains(coalesce(h, []), x))), '|') AS low_only,
  (len(t) = 0 OR len(list_filter(t, lambda x: contains(x, 'null') OR contains(x, 'mixed'))) > 0) AS may_be_null FROM s""")
def type_set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: unions, intersections and differences of sets."""
    e = read(spark, sf_dir, "events").groupBy("user_id").agg(sets.gathered(F.col("event_type")).alias("t"), sets.gathered(F.when(F.col("value") > 50, F.col("event_type"))).alias("h"))
    return e.select("user_id", F.array_join("t", "|").alias("types"), F.array_join(sets.intersect(F.col("t"), F.col("h")), "|").alias("high_types"), F.array_join(sets.erase(F.col("t"), F.col("h")), "|").alias("low_only"), sets.may_be_null(F.col("t")).alias("may_be_null"))


@query("""
SELECT p.p_partkey AS use_key, q.p_partkey AS declared_key FROM part p JOIN (SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name) q ON lower(p.p_type || ' ' || p.p_name) = lower(p.p_type) || ' ' || q.p_name WHERE p.p_type <> lower(p.p_type)""")
def ci_name_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that match a declaration in all but case."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    declared = p.groupBy("p_name").agg(F.min("p_partkey").alias("declared_key")).withColumnRenamed("p_name", "symbol")
    return symbols.lookup(p.withColumn("use", F.col("p_name")), declared, "use", "symbol").where(F.col("p_type") != F.lower("p_type")).select(F.col("p_partkey").alias("use_key"), "declared_key")


CLOSURE_EDGES = """SELECT DISTINCT child, parent FROM (
  SELECT 'nation:' || n_nationkey AS child, 'region:' || n_regionkey AS parent FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
  UNION ALL SELECT 'region:' || r_regionkey, 'world' FROM region)"""


@query(f"""
WITH RECURSIVE e AS ({CLOSURE_EDGES}), c(child, ancestor, depth) AS (
  SELECT child, parent, 1::BIGINT FROM e UNION SELECT c.child, e.parent, c.depth + 1 FROM c JOIN e ON c.ancestor = e.child)
SELECT child, ancestor, min(depth) AS depth FROM c GROUP BY child, ancestor""")
def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closure of a hierarchy by semi-naive rounds."""
    n, c, r = (read(spark, sf_dir, t) for t in ("nation", "customer", "region"))

    def edge(d: DataFrame, a: str, x: str, b: str, y: str) -> DataFrame:
        return d.select(F.concat(F.lit(a), F.col(x).cast("string")).alias("child"), (F.concat(F.lit(b), F.col(y).cast("string")) if y else F.lit(b)).alias("parent"))

    edges = edge(n, "nation:", "n_nationkey", "region:", "n_regionkey").unionByName(edge(c, "customer:", "c_custkey", "nation:", "c_nationkey")).unionByName(edge(r, "region:", "r_regionkey", "world", ""))
    return hierarchy.closure(edges)


@query("""
WITH h AS (SELECT o_custkey, o_orderkey, epoch(o_orderdate)::BIGINT // 86400 AS a, epoch(o_orderdate)::BIGINT // 86400 + 30 AS b FROM orders)
SELECT x.o_orderkey AS old_key, y.o_orderkey AS new_key FROM h x JOIN h y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey AND x.a <= y.b AND x.b >= y.a""")
def hunk_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges that overlap within one file."""
    day = F.floor(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) / 86400)
    h = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", day.alias("a"), (day + 30).alias("b"))
    x, y = h.alias("x"), h.alias("y")
    on = (F.col("x.o_custkey") == F.col("y.o_custkey")) & (F.col("x.o_orderkey") < F.col("y.o_orderkey")) & reports.overlaps(F.col("x.a"), F.col("x.b"), F.col("y.a"), F.col("y.b"))
    return x.join(y, on).select(F.col("x.o_orderkey").alias("old_key"), F.col("y.o_orderkey").alias("new_key"))


L = "(SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents)"
OLD = f"(SELECT source AS file, md5(line) AS hash FROM {L} WHERE doc_id IN (SELECT doc_id FROM labels))"
NEW = f"(SELECT source AS file, md5(line) AS hash, doc_id FROM {L})"


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a document as a finding; those of labelled documents are the known ones."""
    return _lines(read(spark, sf_dir, "documents")).select(F.col("source").alias("file"), F.md5("line").alias("hash"), "doc_id")


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir).join(read(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")


@query(f"""
WITH o AS (SELECT DISTINCT file, hash FROM {OLD}), n AS (SELECT DISTINCT file, hash FROM {NEW} WHERE doc_id NOT IN (SELECT doc_id FROM labels))
SELECT file, hash, 'added' AS change FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT file, hash, 'deleted' FROM (SELECT * FROM o EXCEPT SELECT * FROM n)""")
def report_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two sets of findings have in addition to each other."""
    old = _known(spark, sf_dir).select("file", "hash").distinct()
    new = _findings(spark, sf_dir).join(read(spark, sf_dir, "labels"), "doc_id", "left_anti").select("file", "hash").distinct()
    return reports.report_diff(old, new, ["file", "hash"])


@query(f"""
WITH o AS (SELECT DISTINCT file, hash FROM {OLD}), n AS (SELECT DISTINCT file, hash FROM {NEW} WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
d AS (SELECT file, 'a' AS change FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT file, 'd' FROM (SELECT * FROM o EXCEPT SELECT * FROM n))
SELECT file AS "check", count(*) FILTER (WHERE change = 'a') AS added, count(*) FILTER (WHERE change = 'd') AS deleted FROM d GROUP BY file""")
def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a difference."""
    return reports.diff_summary(report_diff(spark, sf_dir), "file")


@query(f"SELECT file, hash, count(*) AS cnt FROM {OLD} GROUP BY file, hash")
def baseline_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each finding is known."""
    return reports.baseline_build(_known(spark, sf_dir))


@query(f"""
WITH b AS (SELECT file, hash, count(*) AS cnt FROM {OLD} GROUP BY file, hash), n AS (SELECT *, row_number() OVER (PARTITION BY file, hash ORDER BY doc_id) AS k FROM {NEW})
SELECT n.file, n.hash, n.doc_id FROM n LEFT JOIN b ON n.file = b.file AND n.hash = b.hash WHERE k > coalesce(cnt, 0)""")
def baseline_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings beyond their known number."""
    return reports.baseline_suppress(_findings(spark, sf_dir), reports.baseline_build(_known(spark, sf_dir)), ["doc_id"])


@query(f"""
WITH b AS (SELECT file, hash, count(*) AS cnt FROM {OLD} GROUP BY file, hash), n AS (SELECT *, row_number() OVER (PARTITION BY file, hash ORDER BY doc_id) AS k FROM {NEW}),
s AS (SELECT CASE substr(n.hash, 1, 1) WHEN '0' THEN 1 WHEN '1' THEN 2 ELSE 3 END AS level FROM n LEFT JOIN b ON n.file = b.file AND n.hash = b.hash WHERE k > coalesce(cnt, 0))
SELECT count(*) AS n_all, count(*) FILTER (WHERE level <> 3) AS n_critical, count(*) FILTER (WHERE level = 3) AS n_minor FROM s""")
def baseline_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: new findings by severity."""
    head = F.substring("hash", 1, 1)
    return reports.severity_stats(baseline_suppress(spark, sf_dir).withColumn("level", F.when(head == "0", 1).when(head == "1", 2).otherwise(3)))


@query(r"""
SELECT doc_id, len(regexp_extract_all(text, '%(?:\d+\$)?[-+ 0]*(?:''.)?\d*(?:\.\d+)?[bcdeEfFgGosuxX%]'))::INT AS n_directives,
  array_to_string(regexp_extract_all(text, '%(?:\d+\$)?[-+ 0]*(?:''.)?\d*(?:\.\d+)?[bcdeEfFgGosuxX%]'), ' ') AS directives FROM documents""")
def printf_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.10: printf directives."""
    d = text.directives(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(d).alias("n_directives"), F.array_join(d, " ").alias("directives"))


@query("""
SELECT n_nationkey, replace(replace('$n belongs to $r ($n)', '$n', n_name), '$r', r_name) AS message FROM nation JOIN region ON n_regionkey = r_regionkey""")
def template_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q9: captures in a message."""
    j = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select("n_nationkey", text.template(F.lit("$n belongs to $r ($n)"), {"n": F.col("n_name"), "r": F.col("r_name")}).alias("message"))


@query("""
SELECT doc_id, repeat(' ', instr(line, ' ')::INT) || repeat('^', greatest(1, length(line) - instr(line, ' ')::INT)::INT) AS caret FROM (SELECT doc_id, string_split(text, chr(10))[1] AS line FROM documents) WHERE line NOT LIKE '%' || chr(9) || '%'""")
def caret_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: the line under a finding's context."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n", -1)[0].alias("line")).where(~F.contains("line", F.lit("\t")))
    return d.select("doc_id", text.caret(F.col("line"), F.instr("line", " "), F.length("line")).alias("caret"))


@query("""
SELECT s_suppkey, coalesce(a.n_name, b.n_name) AS found FROM (SELECT s_suppkey, 'NS_NATION_' || s_nationkey AS full_name, 'NATION_' || s_nationkey AS root_name FROM supplier)
LEFT JOIN nation a ON lower(full_name) = lower(a.n_name) LEFT JOIN nation b ON lower(root_name) = lower(b.n_name)""")
def namespace_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name in its namespace, else in the root."""
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("NS_NATION_"), F.col("s_nationkey").cast("string")).alias("full"), F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")).alias("root"))
    n = read(spark, sf_dir, "nation").select("n_name", F.col("n_name").alias("found"))
    return symbols.with_fallback(s, n, "full", "root", "n_name", "found").select("s_suppkey", "found")


@query("""
SELECT p_partkey, p_size % 3 = 0 AND p_size % 5 = 0 AS generated FROM part""")
def header_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files whose first comment lines say that they are generated and not to be edited."""
    p = read(spark, sf_dir, "part")
    head = F.concat(F.lit("<?php\n// "), F.when(F.col("p_size") % 3 == 0, F.lit("Auto-generated from ")).otherwise(F.lit("Made from ")), "p_name", F.lit("\n# "), F.when(F.col("p_size") % 5 == 0, F.lit("DO NOT EDIT")).otherwise(F.lit("edit")), F.lit("\necho 'do not modify';\n"))
    return p.select("p_partkey", text.auto_generated(head).alias("generated"))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def anti_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that nothing declares."""
    uses = read(spark, sf_dir, "documents").select("doc_id", "source", F.concat(F.lit("Doc_"), F.col("doc_id").cast("string")).alias("used"))
    known = read(spark, sf_dir, "labels").select(F.concat(F.lit("DOC_"), F.col("doc_id").cast("string")).alias("declared"))
    return symbols.undefined(uses, known, "used", "declared").select("doc_id", "source")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def semi_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that something declares."""
    uses = read(spark, sf_dir, "documents").select("doc_id", "source", F.concat(F.lit("Doc_"), F.col("doc_id").cast("string")).alias("used"))
    known = read(spark, sf_dir, "labels").where("quality = 0").select(F.concat(F.lit("DOC_"), F.col("doc_id").cast("string")).alias("declared"))
    return symbols.lookup(uses, known, "used", "declared", "left_semi").select("doc_id", "source")


@query("""
SELECT p_partkey, 'Too few arguments for f' || p_partkey || ', expecting ' || p_size % 7 || ', saw ' || p_partkey % 7 AS message FROM part WHERE p_partkey % 7 < p_size % 7""")
def arity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with fewer arguments than their function has parameters, in a file for each part."""
    key = F.col("p_partkey").cast("string")

    def listed(n: Column, item: Callable[[Column], Column]) -> Column:
        return F.array_join(F.transform(F.slice(F.sequence(F.lit(1), F.lit(7)), F.lit(1), n.cast("int")), item), ", ")

    given, taken = listed(F.col("p_partkey") % 7, lambda i: i.cast("string")), listed(F.col("p_size") % 7, lambda i: F.concat(F.lit("$p"), i.cast("string")))
    code = F.concat(F.lit("<?php function f"), key, F.lit("("), taken, F.lit(") {} f"), key, F.lit("("), given, F.lit(");"))
    nodes = cut(facts.nodes(read(spark, sf_dir, "part").select(key.alias("path"), code.alias("content"))))
    found = relational.undefined(nodes, relational.Symbols(nodes)).where("check_name = 'argCount'")
    return found.select(F.col("filename").cast("long").alias("p_partkey"), "message")


@query("""
SELECT c_custkey, CASE WHEN c_acctbal < 0 AND c_custkey % 2 = 1 THEN 'customer' WHEN c_nationkey % 3 = 0 THEN 'nation' ELSE 'region' END AS found_in,
  CASE WHEN c_acctbal < 0 AND c_custkey % 2 = 1 THEN 0 WHEN c_nationkey % 3 = 0 THEN 1 ELSE 2 END AS depth FROM customer""")
def rank_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The member that a class means: concrete before abstract, then by kind of edge and depth."""
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    up = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    named = {"customer": F.concat(F.lit("c"), F.col("c_custkey").cast("string")), "nation": F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), "region": F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))}
    own = F.array(*[F.struct(v.alias("ancestor"), F.lit(k).alias("depth"), F.lit("own" if not k else "extends").alias("kind")) for k, v in enumerate(named.values())])
    ancestors = up.select(named["customer"].alias("child"), F.explode(own).alias("a")).select("child", "a.*")
    members = (
        up.where("c_acctbal < 0").select(named["customer"].alias("cls"), F.lit("customer").alias("found_in"), (F.col("c_custkey") % 2 == 0).alias("is_abstract"))
        .unionByName(n.where("n_nationkey % 3 = 0").select(named["nation"].alias("cls"), F.lit("nation").alias("found_in"), F.lit(False).alias("is_abstract")))
        .unionByName(r.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("cls"), F.lit("region").alias("found_in"), F.lit(False).alias("is_abstract")))
        .withColumn("member", F.lit("RUN"))
    )
    wanted = c.select("c_custkey", named["customer"].alias("cls"), F.lit("run").alias("name"))
    return hierarchy.resolve(wanted, members, ancestors, ["own", "trait", "extends"]).select("c_custkey", "found_in", "depth")


@query("""
SELECT user_id, count(*) AS n_all, count(*) FILTER (WHERE event_type <> 'view') AS n_critical, count(*) FILTER (WHERE event_type = 'view') AS n_minor FROM events GROUP BY user_id""")
def severity_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by severity, in one pass."""
    e = F.col("event_type")
    return reports.severity_stats(read(spark, sf_dir, "events").withColumn("level", F.when(e == "view", 3).when(e == "error", 1).otherwise(2)), by=["user_id"])


DUP_BODY = ("{ $a = ", "; $b = '", "'; echo $a, $b; return $a; }")


@query(f"""
WITH b AS (SELECT p_partkey, '{DUP_BODY[0]}' || p_size || '{DUP_BODY[1].replace("'", "''")}' || p_brand || '{DUP_BODY[2].replace("'", "''")}' AS body FROM part)
SELECT count(*)::INT AS n, min(p_partkey::VARCHAR) AS first, (length(body) * (count(*) - 1))::INT AS score FROM b GROUP BY body HAVING count(*) > 1""")
def dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions with one body in a file for each part, by what they waste."""
    key = F.col("p_partkey").cast("string")
    code = F.concat(F.lit("<?php function f"), key, F.lit("() "), F.lit(DUP_BODY[0]), F.col("p_size").cast("string"), F.lit(DUP_BODY[1]), "p_brand", F.lit(DUP_BODY[2]))
    nodes = facts.nodes(read(spark, sf_dir, "part").select(key.alias("path"), code.alias("content")))
    return lint.duplicates(nodes, least=5).select(F.size("places").alias("n"), F.col("places")[0]["path"].alias("first"), F.col("score").cast("int").alias("score"))


@query("""
SELECT p_partkey, ((p_partkey * 7 + p_size) - 3)::VARCHAR AS added, ((p_partkey & 255) | (p_size & 15))::VARCHAR AS bits, (-p_partkey)::VARCHAR AS negated,
  CASE WHEN p_size > 3 AND NOT (p_partkey >= 50) THEN '1' ELSE '' END AS both_true, p_brand || p_size AS joined, p_partkey::VARCHAR AS casted FROM part""")
def const_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.10: constants of PHP files, one for each part, folded by the engine."""
    p, s = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    exprs = {"added": ["(", p, " * 7 + ", s, ") - 3"], "bits": ["(", p, " & 0xFF) | (", s, " & 15)"], "negated": ["-", p], "both_true": [s, " > 3 && !(", p, " >= 50)"], "joined": ["'", F.col("p_brand"), "' . ", s], "casted": ["(int)", p, ".75"]}
    code = F.concat(F.lit("<?php class K {"), *[F.concat(F.lit(f" const {k} = "), *[F.lit(x) if isinstance(x, str) else x for x in e], F.lit(";")) for k, e in exprs.items()], F.lit(" }"))
    found = fold.constants(read(spark, sf_dir, "part").select(p.alias("path"), code.alias("content")))
    return found.groupBy(F.col("path").cast("long").alias("p_partkey")).agg(*[F.max(F.when(F.col("name") == k, F.col("value"))).alias(k) for k in exprs])


TYPOS = {"onhe": "one", "thnt": "that", "ereson": "reason", "edtion": "edition", "inon": "union", "erti": "verti"}


@query("""
WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\\b[a-z]+\\b')) AS word FROM documents), t(typo, fixed) AS (VALUES %s)
SELECT doc_id, '"' || word || '" is a misspelling of "' || fixed || '"' AS message FROM w JOIN t ON word = typo""" % ", ".join(f"('{a}', '{b}')" for a, b in TYPOS.items()))
def typo_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of comments against a dictionary; each document is the comment of a file."""
    body = F.replace(F.coalesce("text", F.lit("")), F.lit("*/"), F.lit(""))
    files = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.concat(F.lit("<?php\n/* "), body, F.lit(" */")).alias("content"))
    return checks.misspelt(facts.nodes(files), TYPOS).select(F.col("filename").cast("long").alias("doc_id"), "message")


@query("""
SELECT event_id, event_type AS check_name, user_id::INT AS line, '{"check_name":"' || event_type || '","line":' || user_id || ',"event_id":' || event_id || '}' AS value FROM events""")
def json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings written as JSON and read back."""
    found = read(spark, sf_dir, "events").select(F.col("event_type").alias("check_name"), F.col("user_id").cast("int").alias("line"), "event_id")
    return lint.read_json(lint.as_json(found), "check_name string, line int, event_id long").select("event_id", "check_name", "line", "value")


@query("""
SELECT user_id, event_type AS check_name, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS place FROM events GROUP BY user_id, event_type""")
def checker_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks by their number of findings."""
    return reports.ranking(read(spark, sf_dir, "events").withColumnRenamed("event_type", "check_name"), by=["user_id"])


POWERS = [36**k for k in range(11)]


@query(f"""
SELECT c_custkey, coalesce(nullif(ltrim(array_to_string(list_transform({POWERS[::-1]}, lambda p: substr('0123456789abcdefghijklmnopqrstuvwxyz', ((c_custkey * 2654435761) // p % 36)::INT + 1, 1)), ''), '0'), ''), '0') AS item, c_custkey * 2654435761 AS back FROM customer""")
def base36_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A baseline written in base 36 and read back."""
    known = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("file"), (F.col("c_custkey") * F.lit(2654435761)).cast("decimal(20,0)").alias("hash"), F.lit(1).cast("long").alias("cnt"))
    items = lint.baseline_items(known)
    return items.join(lint.read_baseline(items), "file").select(F.col("file").cast("long").alias("c_custkey"), F.col("items")[0].alias("item"), F.col("hash").cast("long").alias("back"))
