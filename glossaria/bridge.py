"""Queries that run the catalog operators over the driver's tables, and the same in SQL.

Relations of a catalog are derived from the tables: parts become keys in code and in
store, documents become messages of the locale that is their language, customers become
dashed keys. Two queries render Python or Fluent text from rows and read it back with
the real scanner or parser, while their SQL computes the rows without either.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fluent
from .functions import text as text_functions
from .functions.pyscan import ScanOptions
from .operators import closure, keys, reconcile, stub
from .operators import untranslated as report
from .plans import engine
from .sources.files import read_files
from .sources.sinks import write_files
from .sources.stored import code_calls, entry_rows, stored_entries
from .streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _arguments(c: str):
    return F.when(F.col(c) % 3 == 0, F.array().cast("array<string>")).when(F.col(c) % 3 == 1, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every part is in code or in store: small ones only in store, large ones only in code, most in both."""
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand").withColumn("key", F.concat(F.lit("part-"), F.col("p_partkey").cast("string"))).withColumn("locale", F.lit("en"))
    file = F.concat("p_brand", F.lit(".ftl"))
    code = part.filter("p_size >= 5").select("locale", "key", file.alias("ftl_path"), _arguments("p_size").alias("kwargs"))
    old = F.when(F.col("p_partkey") % 11 == 0, "old.ftl").otherwise(file)
    stored = part.filter("p_size <= 45").select("locale", "key", old.alias("ftl_path"), F.when(F.col("p_partkey") % 5 == 1, F.array(F.lit("z"))).otherwise(_arguments("p_size")).alias("kwargs"))
    return code, stored


_SIDES = """
WITH code AS (SELECT concat('part-', CAST(p_partkey AS VARCHAR)) AS k, concat(p_brand, '.ftl') AS path,
       CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN 'a' ELSE 'a,b' END AS kw FROM part WHERE p_size >= 5),
 stored AS (SELECT concat('part-', CAST(p_partkey AS VARCHAR)) AS k,
       CASE WHEN p_partkey % 11 = 0 THEN 'old.ftl' ELSE concat(p_brand, '.ftl') END AS path,
       CASE WHEN p_partkey % 5 = 1 THEN 'z' ELSE CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN 'a' ELSE 'a,b' END END AS kw
       FROM part WHERE p_size <= 45),
 st AS (SELECT coalesce(c.k, s.k) AS k, c.path AS code_path, s.path AS stored_path, CASE WHEN s.k IS NULL THEN 'added' WHEN c.k IS NULL THEN 'obsolete'
       WHEN c.path <> s.path THEN 'moved' WHEN c.kw <> s.kw THEN 'kwargs_changed' ELSE 'unchanged' END AS status
   FROM code c FULL OUTER JOIN stored s ON c.k = s.k)
"""


@query(_SIDES + "SELECT status, count(*) AS n FROM st GROUP BY status")
def reconcile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.statuses(*_sides(spark, sf_dir)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(_SIDES + "SELECT k AS key, status, code_path AS code_file, stored_path AS stored_file FROM st")
def reconcile_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.statuses(*_sides(spark, sf_dir)).select("key", "status", "code_file", "stored_file")


@query(
    _SIDES
    + """SELECT 'en' AS locale, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status IN ('moved', 'kwargs_changed')) AS updated,
  count(*) FILTER (status IN ('moved', 'kwargs_changed', 'obsolete')) AS commented, count(*) FILTER (status = 'unchanged') AS unchanged, CAST(0 AS BIGINT) AS retained FROM st"""
)
def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.statistics(reconcile.statuses(*_sides(spark, sf_dir)))


_MESSAGES = """
WITH m AS (SELECT lang AS locale, concat(source, '.ftl') AS file_path, doc_id, concat('m-', CAST(doc_id // 5 AS VARCHAR)) AS k,
       CASE WHEN doc_id % 3 = 0 AND lang <> 'de' THEN concat('m-', CAST(doc_id // 5 AS VARCHAR)) ELSE trim(text, ' ') END AS v FROM documents)
"""


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as messages, their whole text as value; five neighbours share a key."""
    key = F.concat(F.lit("m-"), F.expr("doc_id div 5").cast("string"))
    value = F.when((F.col("doc_id") % 3 == 0) & (F.col("lang") != "de"), key).otherwise(F.trim("text"))
    return _table(spark, sf_dir, "documents").select(F.col("lang").alias("locale"), F.concat("source", F.lit(".ftl")).alias("file_path"), key.alias("key"), value.alias("value"), F.col("doc_id").alias("line"), F.lit(False).alias("ignore_untranslated"), F.lit(0).alias("scan"))


@query(
    _MESSAGES
    + """, sug AS (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY file_path, doc_id) AS rn FROM m WHERE locale = 'es' AND v <> k AND v <> '')
SELECT m.locale, m.file_path, m.k AS key, m.doc_id AS line, s.v AS suggestion FROM m LEFT JOIN sug s ON m.k = s.k AND s.rn = 1 WHERE m.v = m.k"""
)
def untranslated(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _messages(spark, sf_dir)
    found = report.untranslated(m, m, spark.createDataFrame([("es", 0)], "locale string, rank int"))
    return found.select("locale", "file_path", "key", "line", F.try_element_at("suggestions", F.lit(1))["value"].alias("suggestion"))


@query(
    _MESSAGES
    + """, r AS (SELECT * FROM (VALUES ('fr', 0), ('es', 1), ('de', 2)) t(locale, rank)),
f AS (SELECT k, locale, rank, v, row_number() OVER (PARTITION BY k, locale ORDER BY file_path, doc_id) AS rn FROM m JOIN r USING (locale) WHERE v <> k AND v <> ''),
s AS (SELECT k, string_agg(locale || '=' || v, '|' ORDER BY rank) AS suggestions FROM f WHERE rn = 1 GROUP BY k)
SELECT m.doc_id AS line, coalesce(s.suggestions, '') AS suggestions FROM m LEFT JOIN s USING (k) WHERE m.v = m.k"""
)
def suggestion_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _messages(spark, sf_dir)
    ranks = spark.createDataFrame([("fr", 0), ("es", 1), ("de", 2)], "locale string, rank int")
    shown = F.array_join(F.transform("suggestions", lambda s: F.concat_ws("=", s["locale"], s["value"])), "|")
    return report.untranslated(m, m, ranks).select("line", shown.alias("suggestions"))


@query(_MESSAGES + "SELECT DISTINCT locale FROM m WHERE locale NOT IN (SELECT locale FROM m WHERE v = k)")
def fully_translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _messages(spark, sf_dir)
    return report.fully_translated(m.select("locale").distinct(), report.placeholders(m))


@query(_MESSAGES + "SELECT locale, doc_id AS line, CAST(row_number() OVER (PARTITION BY locale ORDER BY file_path, k, doc_id) AS INTEGER) AS number FROM m WHERE v = k")
def report_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.numbered(report.placeholders(_messages(spark, sf_dir))).select("locale", "line", "number")


@query(_MESSAGES + "SELECT locale, count(*) AS n FROM m WHERE v = k GROUP BY locale")
def report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.counts(report.placeholders(_messages(spark, sf_dir)))


@query("""SELECT CAST(o_custkey AS VARCHAR) AS key, count(DISTINCT o_orderpriority) AS n_paths, count(DISTINCT o_orderstatus) AS n_messages, count(*) AS n_calls,
  CASE WHEN count(DISTINCT o_orderpriority) > 1 THEN 'path' ELSE 'message' END AS reason
FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) > 1 OR count(DISTINCT o_orderstatus) > 1""")
def key_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    calls = orders.select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderpriority").alias("ftl_path"), F.array("o_orderstatus").alias("kwargs"), F.lit("orders.py").alias("code_path"), F.col("o_orderkey").alias("ordinal"))
    return keys.conflicts(keys.merge_calls(calls))


@query("SELECT CAST(o_custkey AS VARCHAR) AS key, arg_min(o_orderpriority, o_orderkey) AS ftl_path, count(*) AS n_calls FROM orders GROUP BY o_custkey")
def merged_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    calls = orders.select(F.col("o_custkey").cast("string").alias("key"), F.col("o_orderpriority").alias("ftl_path"), F.array("o_orderstatus").alias("kwargs"), F.lit("orders.py").alias("code_path"), F.col("o_orderkey").alias("ordinal"))
    return keys.merge_calls(calls).select("key", "ftl_path", "n_calls")


@query("""WITH RECURSIVE e AS (SELECT concat('n', n_nationkey) AS src, concat('r', n_regionkey) AS dst FROM nation UNION ALL SELECT concat('r', r_regionkey), concat('r', r_regionkey - 1) FROM region WHERE r_regionkey > 2),
c(source, node) AS (SELECT src, dst FROM e WHERE src LIKE 'n%' UNION SELECT c.source, e.dst FROM c JOIN e ON c.node = e.src)
SELECT source, node FROM c""")
def closure_acyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    edges = nation.select(name("n", F.col("n_nationkey")).alias("src"), name("r", F.col("n_regionkey")).alias("dst")).union(region.filter("r_regionkey > 2").select(name("r", F.col("r_regionkey")), name("r", F.col("r_regionkey") - 1)))
    return closure.reachable(edges, nation.select(name("n", F.col("n_nationkey")).alias("source")))


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS src, c_custkey // 10 * 10 + (3 * c_custkey + 1) % 10 AS dst FROM customer UNION SELECT c_custkey, c_custkey // 10 * 10 + (c_custkey + 1) % 10 FROM customer),
c(source, node) AS (SELECT src, dst FROM e UNION SELECT c.source, e.dst FROM c JOIN e ON c.node = e.src)
SELECT source, node FROM c""")
def closure_cyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each customer reaches over two edges of its own, within its ten, in which they make cycles."""
    customer = _table(spark, sf_dir, "customer")
    edges = customer.select(F.col("c_custkey").alias("src"), F.explode(F.array(F.expr("c_custkey div 10 * 10 + (3 * c_custkey + 1) % 10"), F.expr("c_custkey div 10 * 10 + (c_custkey + 1) % 10"))).alias("dst"))
    return closure.reachable(edges, customer.select(F.col("c_custkey").alias("source")))


_TREE_KEYS = "SELECT concat(lower(c_mktsegment), '-', CAST(c_nationkey AS VARCHAR), '-', CAST(c_custkey AS VARCHAR)) AS key FROM customer UNION ALL SELECT DISTINCT concat(lower(c_mktsegment), '-', CAST(c_nationkey AS VARCHAR)) FROM customer WHERE c_nationkey < 5"


@query(f"""WITH k AS ({_TREE_KEYS}), p AS (SELECT string_split(key, '-') AS parts, key FROM k),
n AS (SELECT array_to_string(parts[1:i], '-') AS path, len(parts) = i AS ends, i FROM (SELECT parts, unnest(range(1, len(parts) + 1)) AS i FROM p))
SELECT path, CAST(max(i) AS INTEGER) AS depth, bool_or(ends) AS has_meta, bool_or(NOT ends) AS has_children FROM n GROUP BY path""")
def prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    full = F.concat_ws("-", F.lower("c_mktsegment"), F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string"))
    short = F.concat_ws("-", F.lower("c_mktsegment"), F.col("c_nationkey").cast("string"))
    messages = c.select(full.alias("key")).union(c.filter("c_nationkey < 5").select(short).distinct()).withColumns({"args": F.array().cast("array<string>"), "translation": F.col("key")})
    return stub.prefix_tree(messages).select(F.array_join("path", "-").alias("path"), "depth", "has_meta", "has_children")


@query("SELECT doc_id, md5(replace(replace(text, chr(13), ''), chr(10), chr(13) || chr(10))) AS crlf, md5(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS lf FROM documents")
def line_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = lambda mode: F.md5(text_functions.line_endings(F.col("text"), mode).cast("binary"))
    return _table(spark, sf_dir, "documents").select("doc_id", hashed("crlf").alias("crlf"), hashed("lf").alias("lf"))


@query("SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '\\', '\\\\'), chr(39), '\\' || chr(39)), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')) AS escaped FROM documents")
def literal_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(text_functions.literal_escape(F.col("text")).cast("binary")).alias("escaped"))


@query("""SELECT p_partkey, list_aggregate(list_transform(list_filter(string_split(replace(p_name, ' ', '_'), '_'), lambda x: x <> ''), lambda x: upper(x[1]) || x[2:]), 'string_agg', '') AS class_name FROM part""")
def pascal_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", text_functions.pascal_case(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("class_name"))


@query("""SELECT concat('src/', p_partkey // 50, '.py') AS code_path, concat('part-', CAST(p_partkey AS VARCHAR)) AS key,
  CASE WHEN p_partkey % 4 = 0 THEN concat(lower(replace(p_brand, '#', '_')), '/_default.ftl') ELSE '_default.ftl' END AS ftl_path,
  CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN 'size' ELSE 'size,price' END AS kwargs FROM part WHERE p_partkey % 5 <> 0""")
def scan_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source text is made of rows, fifty to a file, and scanned; every fifth call has a key that isn't literal."""
    part = _table(spark, sf_dir, "part")
    args = F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, ", size=1").otherwise(", size=1, price=x.y")
    path = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit(', _path="'), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit('"'))).otherwise("")
    name = F.when(F.col("p_partkey") % 5 == 0, F.lit("name")).otherwise(F.concat(F.lit('"part-'), F.col("p_partkey").cast("string"), F.lit('"')))
    call = F.when(F.col("p_partkey") % 2 == 0, "L(").otherwise("i18n.get(")
    lines = part.select(F.expr("concat('src/', p_partkey div 50, '.py')").alias("path"), "p_partkey", F.concat(call, name, args, path, F.lit(")\n")).alias("line"))
    files = lines.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "line"))), lambda x: x["line"]), "").cast("binary").alias("content")).withColumn("size", F.length("content"))
    return code_calls(files, ScanOptions()).select("code_path", "key", "ftl_path", F.array_join("kwargs", ",").alias("kwargs"))


@query("""SELECT concat('part-', CAST(p_partkey AS VARCHAR)) AS key, 'message' AS kind, CAST(row_number() OVER (PARTITION BY p_partkey // 50 ORDER BY p_partkey) - 1 AS INTEGER) AS position,
  CASE WHEN p_size % 3 = 0 THEN p_name END AS text, CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN 'a' ELSE 'n' END AS vars, p_size % 4 = 0 AS ignored FROM part""")
def ftl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fluent text is made of rows, parsed, serialized and parsed again."""
    part = _table(spark, sf_dir, "part")
    value = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).when(F.col("p_size") % 3 == 1, F.concat("p_name", F.lit(" { $a }"))).otherwise(F.concat(F.lit("\n    { $n ->\n        [one] "), F.col("p_name"), F.lit("\n       *[other] { $n } pieces\n    }")))
    line = F.concat(F.when(F.col("p_size") % 4 == 0, "# ignore\n").otherwise(""), F.lit("part-"), F.col("p_partkey").cast("string"), F.lit(" = "), value, F.lit("\n"))
    files = part.select(F.expr("p_partkey div 50").alias("file"), "p_partkey", line.alias("line")).groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "line"))), lambda x: x["line"]), "").alias("content"))

    def run(frames):
        for frame in frames:
            rows = []
            for content in frame["content"]:
                again = fluent.serialize(fluent.parse(content, strict=True))
                rows += [(r[5], r[4], r[3], r[6], ",".join(r[11]), r[8]) for r in entry_rows("en", "x", "x", again.encode())]
            yield pd.DataFrame(rows, columns=["key", "kind", "position", "text", "vars", "ignored"])

    return files.select("content").mapInPandas(run, "key string, kind string, position int, text string, vars string, ignored boolean")


@query("""SELECT CAST(doc_id AS VARCHAR) AS path, lang = 'es' OR n_chars % 7 = 0 AS parse FROM documents WHERE lang <> 'de'""")
def incremental_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: one language is new, another is only in the state, some have another size there."""
    docs = _table(spark, sf_dir, "documents")
    files = docs.filter("lang <> 'de'").select(F.col("doc_id").cast("string").alias("path"), (F.col("n_chars") + F.when(F.col("n_chars") % 7 == 0, 1).otherwise(0)).alias("size"), F.lit(1).cast("long").alias("mtime_ns"))
    state = docs.filter("lang <> 'es'").select(F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size"), F.lit(1).cast("long").alias("mtime_ns"), F.array().cast("array<struct<ordinal: int, key: string, ftl_path: string, kwargs: array<string>>>").alias("calls"))
    changed, kept = incremental.split_files(files, state)
    return changed.select("path", F.lit(True).alias("parse")).union(kept.select("path", F.lit(False)))


@query("""SELECT s.s_nationkey AS locale, c.c_custkey AS key FROM customer c JOIN (SELECT DISTINCT s_nationkey FROM supplier) s ON c.c_nationkey <> s.s_nationkey""")
def missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that a locale lacks: the keys of every locale, less what is there."""
    wanted = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("own"))
    locales = [r[0] for r in _table(spark, sf_dir, "supplier").select("s_nationkey").distinct().collect()]
    each = wanted.withColumn("locale", F.explode(F.array(*[F.lit(x) for x in locales]).cast("array<int>")))
    return each.join(wanted.select("key", F.col("own").alias("locale")), ["key", "locale"], "left_anti").select("locale", "key")


_CATALOG = """
WITH RECURSIVE loc AS (SELECT * FROM (VALUES ('en', 99), ('de', 30)) t(locale, most)),
b AS (SELECT locale, p.* FROM part p JOIN loc ON p_size <= most),
node AS (SELECT locale, concat('message:part-', p_partkey) AS node, CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN 'a' ELSE 'b' END AS var FROM b
   UNION SELECT locale, concat('term:', p_brand), 't' FROM b),
e AS (SELECT * FROM (SELECT locale, concat('message:part-', p_partkey) AS src, CASE WHEN p_type = 'PROMO' THEN concat('message:part-', p_partkey // 2) WHEN p_type = 'LARGE' THEN concat('term:', p_brand) END AS dst FROM b) x
   WHERE EXISTS (SELECT 1 FROM node WHERE node.locale = x.locale AND node.node = x.dst)),
"""


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as messages of two locales; some refer to the part of half their number, some to the term of their brand."""
    part = _table(spark, sf_dir, "part").withColumn("locale", F.explode(F.when(F.col("p_size") <= 30, F.array(F.lit("en"), F.lit("de"))).otherwise(F.array(F.lit("en")))))
    none = F.array().cast("array<struct<ref_kind: string, ref: string>>")
    ref = lambda kind, to: F.array(F.struct(F.lit(kind).alias("ref_kind"), to.alias("ref")))
    refs = F.when(F.col("p_type") == "PROMO", ref("message", F.concat(F.lit("part-"), F.expr("p_partkey div 2").cast("string")))).when(F.col("p_type") == "LARGE", ref("term", F.col("p_brand"))).otherwise(none)
    own = F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>")).when(F.col("p_size") % 3 == 1, F.array(F.lit("a"))).otherwise(F.array(F.lit("b")))
    messages = part.select("locale", F.lit("message").alias("kind"), F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("key"), own.alias("vars"), refs.alias("refs"))
    return messages.union(part.select("locale", F.lit("term"), "p_brand", F.array(F.lit("t")), none).distinct())


@query(
    _CATALOG
    + """c(locale, source, node) AS (SELECT DISTINCT locale, node, node FROM node WHERE node LIKE 'message:%' UNION SELECT c.locale, c.source, e.dst FROM c JOIN e ON c.locale = e.locale AND c.node = e.src)
SELECT c.locale, substr(c.source, 9) AS key, coalesce(string_agg(DISTINCT n.var, ',' ORDER BY n.var), '') AS args FROM c JOIN node n ON c.locale = n.locale AND c.node = n.node GROUP BY c.locale, c.source"""
)
def transitive_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reconcile.transitive_arguments(_catalog(spark, sf_dir))
    return found.select("locale", "key", F.array_join(F.array_sort("kwargs"), ",").alias("args"))


_RETAINED = (
    _CATALOG
    + """c(locale, node) AS (SELECT e.locale, dst FROM e JOIN b ON e.locale = b.locale AND src = concat('message:part-', p_partkey) AND p_size >= 5 WHERE dst LIKE 'message:%'
   UNION SELECT e.locale, e.dst FROM c JOIN e ON c.locale = e.locale AND c.node = e.src WHERE e.dst LIKE 'message:%'),
code AS (SELECT locale, concat('part-', p_partkey) AS k FROM part, loc WHERE p_size >= 5),
stored AS (SELECT locale, concat('part-', p_partkey) AS k FROM b),
st AS (SELECT coalesce(a.locale, s.locale) AS locale, coalesce(a.k, s.k) AS key, CASE WHEN s.k IS NULL THEN 'added' WHEN a.k IS NOT NULL THEN 'unchanged'
    WHEN EXISTS (SELECT 1 FROM c WHERE c.locale = s.locale AND c.node = concat('message:', s.k)) THEN 'retained' ELSE 'obsolete' END AS status
  FROM code a FULL JOIN stored s ON a.locale = s.locale AND a.k = s.k)
"""
)


def _retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small parts are no longer in code; of these, those that parts in use refer to are kept."""
    best = _catalog(spark, sf_dir)
    keys_of = _table(spark, sf_dir, "part").filter("p_size >= 5").select(F.explode(F.array(F.lit("en"), F.lit("de"))).alias("locale"), F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("key"), F.lit("x.ftl").alias("ftl_path"), F.array().cast("array<string>").alias("kwargs"))
    stored = best.filter("kind = 'message'").select("locale", "key", F.lit("x.ftl").alias("ftl_path"), F.array().cast("array<string>").alias("kwargs"))
    in_use = stored.join(keys_of.select("locale", "key"), ["locale", "key"], "left_semi").select("locale", "key")
    return reconcile.statuses(keys_of, stored, reconcile.protected_keys(best, in_use))


@query(_RETAINED + "SELECT locale, key, status FROM st")
def retained_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retained(spark, sf_dir).select("locale", "key", "status")


@query(
    _RETAINED
    + """SELECT locale, count(*) FILTER (status = 'added') AS added, CAST(0 AS BIGINT) AS updated, count(*) FILTER (status = 'obsolete') AS commented,
  count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status = 'retained') AS retained FROM st GROUP BY locale"""
)
def statistics_by_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.statistics(_retained(spark, sf_dir))


#: A value in each form that the argument rules tell apart, with what the rules make of it:
#: variables for reconciliation, references, and variables of a stub's signature.
_FORMS = (
    ("{ $a } and { $b }", "a,b", "", "a,b"),
    ("{ NUMBER($a, minimumFractionDigits: 2) }", "", "", "a"),
    ("{ { $a } }", "", "", "a"),
    ("{ $n ->\n    [one] { $a }\n   *[other] { $b }\n }", "n,a,b", "", "n,a,b"),
    ("{ -brand(case: \"x\") } { -brand }", "", "term:brand", ""),
    ("{ other.title } { other }", "", "message:other", ""),
    ("{ NUMBER($n) ->\n   *[other] { $a }\n }", "a", "", "n,a"),
    ("{ \"text\" } { 5 }", "", "", ""),
)


@query("SELECT concat('part-', p_partkey) AS key, f.vars, f.refs, f.args FROM part JOIN (VALUES " + ", ".join(f"({i}, '{v}', '{r}', '{a}')" for i, (_, v, r, a) in enumerate(_FORMS)) + ") f(form, vars, refs, args) ON p_size % 8 = f.form")
def argument_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fluent text with every form of expression, parsed; one file for fifty parts."""
    part = _table(spark, sf_dir, "part")
    value = F.element_at(F.array(*[F.lit(f[0]) for f in _FORMS]), (F.col("p_size") % 8 + 1).cast("int"))
    line = F.concat(F.lit("part-"), F.col("p_partkey").cast("string"), F.lit(" = "), value, F.lit("\n"))
    files = part.select(F.expr("p_partkey div 50").alias("file"), "p_partkey", line.alias("line")).groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "line"))), lambda x: x["line"]), "").cast("binary").alias("content"))
    entries = stored_entries(files.select(F.lit("en").alias("root"), F.lit("x").alias("path"), F.lit("x").alias("rel_path"), "content"))
    refs = F.transform("refs", lambda r: F.concat_ws(":", r["ref_kind"], r["ref"]))
    return entries.select("key", F.array_join("vars", ",").alias("vars"), F.array_join(F.array_distinct(refs), ",").alias("refs"), F.array_join("args", ",").alias("args"))


def _in_files(rows: DataFrame, path: Column, order: str, line: Column) -> DataFrame:
    """(path, content): the lines of each path, in order, joined."""
    return rows.select(path.alias("path"), F.col(order).alias("nth"), line.alias("line")).groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "line"))), lambda x: x["line"]), "").alias("content"))


def _folder(spark: SparkSession) -> str:
    """A new folder in the one that all executors share."""
    closure._shared_folder(spark)
    return f"{urlparse(spark.sparkContext.getCheckpointDir()).path}/catalog-{uuid.uuid4().hex[:12]}"


def _file() -> Column:
    return F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit("/_default.ftl"))


def _key() -> Column:
    return F.concat(F.lit("part-"), F.col("p_partkey").cast("string"))


@query("""
WITH loc AS (SELECT * FROM (VALUES ('en', 45), ('de', 30)) t(locale, most)),
p AS (SELECT *, concat('part-', p_partkey) AS k, concat(lower(replace(p_brand, '#', '_')), '/_default.ftl') AS path, CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN 'a' ELSE 'a,b' END AS kw FROM part),
s AS (SELECT locale, k, CASE WHEN p_size % 11 = 0 THEN 'old.ftl' ELSE path END AS path, CASE WHEN p_size % 5 = 1 THEN 'z' ELSE kw END AS kw FROM p, loc WHERE p_size <= most),
c AS (SELECT locale, k, path, kw FROM p, loc WHERE p_size >= 5)
SELECT locale, path AS file, k AS key, 'live' AS state, kw AS vars FROM c
UNION ALL SELECT s.locale, s.path, s.k, 'commented', '' FROM s LEFT JOIN c ON s.locale = c.locale AND s.k = c.k WHERE c.k IS NULL OR c.path <> s.path OR c.kw <> s.kw""")
def extract_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and catalogs of two locales are written, brought up to date by the verb, and read again."""
    folder, part = _folder(spark), _table(spark, sf_dir, "part")
    args = F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, ", a=1").otherwise(", a=1, b=x")
    call = F.concat(F.lit('i18n.get("'), _key(), F.lit('"'), args, F.lit(', _path="'), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit('")\n'))
    write_files(_in_files(part.filter("p_size >= 5"), F.concat(F.lit(f"{folder}/code/m"), F.expr("p_partkey div 50"), F.lit(".py")), "p_partkey", call))
    variables = F.when(F.col("p_size") % 5 == 1, " { $z }").when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, " { $a }").otherwise(" { $a } { $b }")
    own = F.when(F.col("p_size") % 11 == 0, "old.ftl").otherwise(_file())
    for locale, most in (("en", 45), ("de", 30)):
        write_files(_in_files(part.filter(F.col("p_size") <= most), F.concat(F.lit(f"{folder}/locales/{locale}/"), own), "p_partkey", F.concat(_key(), F.lit(" = "), F.col("p_name"), variables, F.lit("\n"))))
    engine.extract(spark, engine.ExtractConfig(f"{folder}/code", f"{folder}/locales", ("en", "de")))
    entries = stored_entries(read_files(spark, [f"{folder}/locales/{x}" for x in ("en", "de")], ".ftl", content=False))
    live = entries.filter("kind = 'message'").select("locale", F.col("rel_path").alias("file"), "key", F.lit("live").alias("state"), F.array_join("vars", ",").alias("vars"))
    lines = F.regexp_extract_all("src", F.lit(r"(?m)^# (part-[0-9]+) ="), F.lit(1))
    return live.union(entries.filter("kind = 'comment'").select("locale", "rel_path", F.explode(lines), F.lit("commented"), F.lit("")))


@query("""
WITH p AS (SELECT *, concat('part-', p_partkey) AS k, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INTEGER) AS line FROM part)
SELECT locale, concat(locale, '/', lower(replace(p_brand, '#', '_')), '/_default.ftl') AS file_path, k AS key, line, p_name AS suggestion
FROM p, (VALUES ('de'), ('fr')) l(locale) WHERE CASE locale WHEN 'de' THEN p_size % 4 = 0 AND p_size % 8 <> 0 ELSE p_size % 6 = 0 END""")
def checked_catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogs of three locales are written and checked by the verb; some placeholders are marked to be ignored."""
    folder, part = _folder(spark), _table(spark, sf_dir, "part")
    for locale, every, ignored in (("en", 100, 100), ("de", 4, 8), ("fr", 6, 100)):
        value = F.when(F.col("p_size") % every == 0, _key()).otherwise(F.col("p_name"))
        mark = F.when(F.col("p_size") % ignored == 0, "# ignore\n").otherwise("")
        write_files(_in_files(part, F.concat(F.lit(f"{folder}/{locale}/"), _file()), "p_partkey", F.concat(mark, _key(), F.lit(" = "), value, F.lit("\n"))))
    found = engine.check_untranslated(spark, engine.UntranslatedConfig(folder, ("de", "fr"), ("en",))).untranslated
    return found.select("locale", "file_path", "key", "line", F.try_element_at("suggestions", F.lit(1))["value"].alias("suggestion"))


@query("""
SELECT concat('n', p_partkey) AS name, CASE p_size % 3 WHEN 0 THEN '**kwargs: Any' WHEN 1 THEN '*, a: Any, **kwargs: Any' ELSE '*, a: Any, b: Any, **kwargs: Any' END AS args,
  concat(p_name, CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN ' { $a }' ELSE ' { $a } { $b }' END) AS literal FROM part""")
def stub_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog is written, the verb makes its stub, and the stub's methods are read."""
    folder, part = _folder(spark), _table(spark, sf_dir, "part")
    variables = F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, " { $a }").otherwise(" { $a } { $b }")
    key = F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("-n"), F.col("p_partkey").cast("string"))
    write_files(_in_files(part, F.concat(F.lit(f"{folder}/en/"), _file()), "p_partkey", F.concat(key, F.lit(" = "), F.col("p_name"), variables, F.lit("\n"))))
    engine.generate_stub(spark, f"{folder}/en", f"{folder}/stub.pyi", export_tree=True)
    method = r"def (\w+)\((.*)\) -> Literal\['(.*)'\]:"
    lines = spark.read.text(f"file://{folder}/stub.pyi").filter(F.col("value").rlike(method))
    return lines.select(*[F.regexp_extract("value", method, i).alias(c) for i, c in enumerate(("name", "args", "literal"), 1)])


@query("""
SELECT concat('f', p_partkey // 50) AS file, concat('part-n', p_partkey) AS key, CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN 'size' ELSE 'size,price' END AS kwargs, false AS bad FROM part
UNION ALL SELECT 'broken', NULL, NULL, true""")
def scan_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys as attributes, below a prefix, nested and by name; one file isn't Python, one isn't UTF-8."""
    part = _table(spark, sf_dir, "part")
    n, args = F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, "size=1").otherwise("size=1, price=x.y")
    comma = F.when(F.col("p_size") % 3 == 0, "").otherwise(", ")
    forms = [F.concat(F.lit("i18n.part.n"), n, F.lit("("), args, F.lit(")")), F.concat(F.lit("self.i18n.part.n"), n, F.lit("("), args, F.lit(")")), F.concat(F.lit('print(self.i18n.get("part-n'), n, F.lit('"'), comma, args, F.lit("))")), F.concat(F.lit('L("part-n'), n, F.lit('"'), comma, args, F.lit(")"))]
    line = F.concat(F.element_at(F.array(*forms), (F.col("p_partkey") % 4 + 1).cast("int")), F.lit("\n"))
    files = _in_files(part, F.concat(F.lit("f"), F.expr("p_partkey div 50")), "p_partkey", line).select("path", F.col("content").cast("binary").alias("content"))
    odd = spark.createDataFrame([("broken", bytearray(b'L("x"\n')), ("latin", bytearray(b'L("\xe9")\n'))], "path string, content binary")
    calls = code_calls(files.union(odd).withColumn("size", F.length("content")), ScanOptions(prefixes=frozenset(["self"])))
    return calls.select(F.col("code_path").alias("file"), "key", F.array_join("kwargs", ",").alias("kwargs"), F.col("error").isNotNull().alias("bad"))
