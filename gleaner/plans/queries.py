"""Registered queries over the star-schema tables, each next to its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import paths as P
from gleaner.operators import affected, calls, diff, metrics, ranking, rollup, scores, tables, timeline
from gleaner.plans import analyzer
from gleaner.sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


# Views in SQL that mirror gleaner.sources.tables.
COMMITS = "commits AS (SELECT o_orderpriority AS dataset, o_orderkey AS commit_id, o_custkey AS author, o_orderdate AS date, (o_orderstatus = 'F')::INT AS label, o_totalprice AS x FROM orders)"
METHODS = """methods AS (SELECT l_orderkey AS commit_id, concat_ws('::', l_linenumber, l_partkey, l_suppkey) AS method_id, l_partkey AS file, l_suppkey AS cls,
  CASE l_returnflag WHEN 'A' THEN 'ADD' WHEN 'R' THEN 'RENAME' ELSE 'MODIFY' END AS change_type, l_quantity AS cc, l_extendedprice AS volume, l_discount AS nargs, l_tax AS nexits FROM lineitem)"""
SPANS = "spans AS (SELECT p_brand AS file, p_partkey AS method, split_part(p_type, ' ', 1) AS cls, p_type AS name, (p_partkey % 500)::INT AS s, (p_partkey % 500 + p_size)::INT AS e FROM part)"
LINES = "lines AS (SELECT DISTINCT p_brand AS file, (l_partkey % 500 + l_linenumber)::INT AS line FROM lineitem JOIN part ON l_partkey = p_partkey)"
SAMPLES = f"{COMMITS}, samples AS (SELECT dataset, 'price' AS feature, x, label AS y FROM commits UNION ALL SELECT dataset, 'author', author::DOUBLE, label FROM commits)"
IDX = f"{COMMITS}, idx AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY date, commit_id) - 1 AS idx FROM commits)"
WINDOWS = """n AS (SELECT dataset, count(*) AS n FROM idx GROUP BY 1), p AS (SELECT dataset, n, greatest(50, floor(n * 0.5))::BIGINT AS a, greatest(20, floor(n * 0.1))::BIGINT AS t, greatest(1, floor(n * 0.1))::BIGINT AS s FROM n),
  win AS (SELECT dataset, w::BIGINT AS window_id, 0::BIGINT AS train_start, a + (w - 1) * s - 1 AS train_end, a + (w - 1) * s AS test_start, a + (w - 1) * s + t - 1 AS test_end FROM p, range(1, 6) r(w) WHERE a + (w - 1) * s + t <= n)"""
STATS = ", ".join(f"round(avg({m}), 6) AS current_{m}_mean, round(max({m}), 6) AS current_{m}_max, round(min({m}), 6) AS current_{m}_min, round(stddev_pop({m}), 6) AS current_{m}_std" for m in ("cc", "volume", "nargs", "nexits"))


@query(f"WITH {METHODS} SELECT commit_id, {STATS}, count(DISTINCT method_id) AS modified_method_count_current, count(DISTINCT method_id) > 0 AS has_modified_methods_current FROM methods GROUP BY commit_id")
def commit_rollup_stats(spark, d):
    return rounded(rollup.commit_rollup(T.method_rows(spark, d), ["cc", "volume", "nargs", "nexits"]))


@query(
    f"WITH {METHODS} SELECT commit_id, count(*) FILTER (change_type = 'ADD') AS current_new_file_count, round(count(*) FILTER (change_type = 'ADD')::DOUBLE / count(*), 6) AS current_new_file_ratio FROM methods GROUP BY commit_id"
)
def commit_new_file_ratio(spark, d):
    return rounded(rollup.new_files(T.method_rows(spark, d)))


@query(
    f"WITH {METHODS}, {COMMITS}, r AS (SELECT commit_id, avg(cc) AS c FROM methods GROUP BY 1) SELECT commit_id, round(c, 6) AS current_cc_mean, c IS NOT NULL AS is_complete_feature FROM commits LEFT JOIN r USING (commit_id)"
)
def commit_completeness(spark, d):
    r = T.method_rows(spark, d).groupBy("commit_id").agg(F.avg("cc").alias("current_cc_mean"))
    return rounded(rollup.complete(T.commits(spark, d).select("commit_id").join(r, "commit_id", "left")))


@query(f"WITH {METHODS} SELECT commit_id, count(DISTINCT (file, cls)) AS class_touched_count_current FROM methods GROUP BY commit_id")
def commit_class_touched(spark, d):
    return rollup.touched_classes(T.method_rows(spark, d))


@query(f"WITH {METHODS} SELECT file, count(DISTINCT cls) AS file_class FROM methods GROUP BY file")
def file_class_count(spark, d):
    return rollup.classes_by_file(T.method_rows(spark, d))


@query(f"WITH {METHODS} SELECT commit_id, method_id, cc FROM methods WHERE change_type <> 'RENAME' AND file % 7 <> 0")
def function_table_filter(spark, d):
    m = T.method_rows(spark, d).withColumn("snapshot_scope", F.when(F.col("change_type") == "RENAME", "parent").otherwise("current"))
    return tables.function_rows(m.withColumn("method_id", F.when(F.col("file") % 7 != 0, F.col("method_id")))).select("commit_id", "method_id", "cc")


@query(f"WITH {METHODS} SELECT commit_id, file, volume FROM methods WHERE change_type = 'MODIFY' AND cls % 2 = 0")
def file_table_filter(spark, d):
    m = T.method_rows(spark, d).withColumns({"snapshot_scope": F.when(F.col("change_type") == "MODIFY", "current").otherwise("parent"), "metric_scope": F.when(F.col("cls") % 2 == 0, "file").otherwise("function")})
    return tables.file_rows(m).select("commit_id", "file", "volume")


_SUFFIXES = [".py", ".SH", ".h", ".tsx", ".bin", "", ".kts", ".longsuffixes"]
_PATHS_SQL = "paths AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 8 THEN 'a/CMakeLists.txt' ELSE 'src/f' || p_partkey || ['.py', '.SH', '.h', '.tsx', '.bin', '', '.kts', '.longsuffixes'][p_partkey % 9 + 1] END AS path FROM part)"


def _paths(spark, d):
    k = F.col("p_partkey")
    suffix = F.get(F.array(*map(F.lit, _SUFFIXES)), (k % 9).cast("int"))
    return T.load(spark, d, "part").select(k.alias("id"), F.when(k % 9 == 8, "a/CMakeLists.txt").otherwise(F.concat(F.lit("src/f"), k.cast("string"), suffix)).alias("path"))


@query(
    f"WITH {_PATHS_SQL} SELECT id, CASE id % 9 WHEN 0 THEN 'python' WHEN 1 THEN 'bash' WHEN 2 THEN 'c' WHEN 3 THEN 'tsx' WHEN 6 THEN 'kotlin' WHEN 8 THEN 'cmake' END AS language, id % 9 IN (0, 1, 2, 3, 6) AS is_other FROM paths"
)
def language_detect(spark, d):
    p = F.col("path")
    langs = ["python", "bash", "shell", "c", "cpp", "tsx", "kotlin", "cmake"]
    return _paths(spark, d).select("id", P.language_of(p, langs).alias("language"), (P.other_source(p) & (P.suffix_of(p) != ".txt")).alias("is_other"))


@query(f"WITH {_PATHS_SQL} SELECT CASE id % 9 WHEN 0 THEN 'python' WHEN 1 THEN 'shell' WHEN 8 THEN 'cmake' END AS language, count(*) AS files FROM paths WHERE id % 9 IN (0, 1, 8) GROUP BY 1")
def languages_present(spark, d):
    langs = P.detected_order(["python", "bash", "shell", "cmake"])
    return _paths(spark, d).select(P.language_of(F.col("path"), langs).alias("language")).filter("language IS NOT NULL").groupBy("language").agg(F.count(F.lit(1)).alias("files"))


_NAMES_SQL = """names AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'current_cc_mean' WHEN 1 THEN 'current_flag' WHEN 2 THEN 'entropy' WHEN 3 THEN 'x_' || p_size || '_std' WHEN 4 THEN 'current_n_max' ELSE 'la' END AS feature FROM part)"""


def _names(spark, d):
    k = F.col("p_partkey")
    x = F.when(k % 6 == 0, "current_cc_mean").when(k % 6 == 1, "current_flag").when(k % 6 == 2, "entropy").when(k % 6 == 3, F.concat(F.lit("x_"), F.col("p_size").cast("string"), F.lit("_std"))).when(k % 6 == 4, "current_n_max").otherwise("la")
    return T.load(spark, d, "part").select(k.alias("id"), x.alias("feature"))


@query(
    f"WITH {_NAMES_SQL} SELECT id, CASE WHEN regexp_matches(feature, '_(mean|max|min|std)$') THEN regexp_replace(regexp_replace(feature, '_(mean|max|min|std)$', ''), '^current_', '') ELSE feature END AS concept FROM names"
)
def concept_normalize(spark, d):
    return _names(spark, d).select("id", P.concept_of(F.col("feature")).alias("concept"))


@query(f"WITH {_NAMES_SQL} SELECT id, CASE WHEN feature IN ('entropy', 'la') THEN 'kamei' ELSE 'new' END AS family FROM names")
def family_label(spark, d):
    return _names(spark, d).select("id", P.family_of(F.col("feature")).alias("family"))


@query("SELECT p_partkey AS id, p_brand || '::' || CASE WHEN p_size % 3 = 0 THEN '<global>' ELSE split_part(p_type, ' ', 1) END || '::' || replace(p_name, ' ', '_') || '::' || p_size AS method_id FROM part")
def method_id_build(spark, d):
    cls = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.split("p_type", " ")[0])
    return T.load(spark, d, "part").select(F.col("p_partkey").alias("id"), P.method_id(F.col("p_brand"), cls, F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_size")).alias("method_id"))


@query(
    "SELECT p_partkey AS id, p_brand AS file, CASE WHEN p_size % 3 = 0 THEN '' ELSE split_part(p_type, ' ', 1) END AS cls, replace(p_name, ' ', '_') AS name, CASE WHEN p_size % 5 <> 0 THEN p_size END AS start_line FROM part"
)
def method_id_parse(spark, d):
    built = method_id_build(spark, d).join(T.load(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size"), "id")
    parts = P.method_id_parts(F.when(F.col("p_size") % 5 == 0, F.concat("method_id", F.lit("x"))).otherwise(F.col("method_id")))
    return built.select("id", parts["file"].alias("file"), parts["class"].alias("cls"), parts["name"].alias("name"), parts["start"].alias("start_line"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN 'pkg' ELSE 'pkg.m' || p_size END AS module FROM part")
def python_module_name(spark, d):
    path = F.when(F.col("p_size") % 4 == 0, "pkg/__init__.py").otherwise(F.concat(F.lit("pkg/m"), F.col("p_size").cast("string"), F.lit(".py")))
    return T.load(spark, d, "part").select(F.col("p_partkey").alias("id"), P.python_module(path).alias("module"))


@query(
    "SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 'run' WHEN 1 THEN 'unknown_method' WHEN 2 THEN 'std.vec<T>' WHEN 3 THEN 'vec' ELSE 'A::b' END AS callable, CASE p_size % 5 WHEN 4 THEN 'A' WHEN 2 THEN 'std' ELSE '' END AS cls, CASE p_size % 5 WHEN 0 THEN 'run' WHEN 1 THEN '' WHEN 2 THEN 'vec' WHEN 3 THEN 'vec' ELSE 'b' END AS target FROM part"
)
def callable_normalize(spark, d):
    m = F.col("p_size") % 5
    raw = F.when(m == 0, "run(int x)").when(m == 1, "(y)").when(m == 2, "std.vec<T>(a)").when(m == 3, "vec<T>").otherwise("A::b(c)")
    head = P.callable_name(raw)
    return T.load(spark, d, "part").select(F.col("p_partkey").alias("id"), head.alias("callable"), P.split_qualified(head)[0].alias("cls"), P.target_name(F.when(m == 4, head).otherwise(raw)).alias("target"))


@query("SELECT doc_id, coalesce(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')), 0)::BIGINT AS tokens, sha1(text) AS digest FROM documents")
def token_count(spark, d):
    return T.load(spark, d, "documents").select("doc_id", P.token_count(F.col("text")).alias("tokens"), F.sha1(F.col("text").cast("binary")).alias("digest"))


_DIFF_SQL = """diffs AS (SELECT l_orderkey AS o, l_linenumber AS n, min(l_partkey % 90 + 1) AS a, min(l_suppkey % 4) AS k FROM lineitem GROUP BY 1, 2)"""


def _diffs(spark, d):
    li = T.load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n")).agg(F.min(F.col("l_partkey") % 90 + 1).alias("a"), F.min(F.col("l_suppkey") % 4).alias("k"))
    s = lambda c: F.col(c).cast("string")
    head = F.concat(F.lit("--- a/f\n+++ b/f\n@@ -"), s("a"), F.lit(",2 +"), s("a"), F.when(F.col("k") == 3, "").otherwise(F.concat(F.lit(","), s("k"))), F.lit(" @@ f\n"))
    return li.select("o", "n", "a", "k", F.concat(head, F.lit(" ctx\n-old\n+new\n+++two\n\\ No newline\n+last\n")).alias("diff"))


@query(f"WITH {_DIFF_SQL} SELECT o, n, a + i AS line FROM diffs, range(3) r(i) WHERE i < CASE k WHEN 3 THEN 1 ELSE k END")
def hunk_lines(spark, d):
    return diff.hunk_lines(_diffs(spark, d), ["o", "n"]).select("o", "n", F.col("line").cast("long").alias("line"))


@query(f"WITH {_DIFF_SQL} SELECT o, n, a + 1 AS line, 'new' AS text, 'added' AS kind FROM diffs UNION ALL SELECT o, n, a + 4, 'last', 'added' FROM diffs UNION ALL SELECT o, n, a + 1, 'old', 'deleted' FROM diffs")
def diff_parse(spark, d):
    p = diff.parse_unified(_diffs(spark, d))
    rows = lambda c: p.select("o", "n", F.explode(c).alias("x")).select("o", "n", F.col("x.line").cast("long").alias("line"), "x.text", F.lit(c).alias("kind"))
    return rows("added").unionByName(rows("deleted"))


@query(f"WITH {_DIFF_SQL} SELECT o, n, a + i AS line FROM diffs, range(5) r(i) WHERE i < CASE k WHEN 3 THEN 1 ELSE k END OR i IN (1, 4)")
def impacted_lines(spark, d):
    return diff.impacted_lines(_diffs(spark, d), ["o", "n"]).select("o", "n", F.col("line").cast("long").alias("line"))


@query(f"WITH {SPANS}, {LINES} SELECT file, method, s AS start, e AS \"end\" FROM spans WHERE EXISTS (SELECT 1 FROM lines WHERE lines.file = spans.file AND line BETWEEN s AND e)")
def affected_methods_range(spark, d):
    return diff.methods_on_lines(T.method_spans(spark, d), T.diff_lines(spark, d)).select("file", "method", "start", "end")


@query(f"WITH {SPANS} SELECT method, greatest(s, 100) <= least(e, 300) AS meets FROM spans")
def range_overlap(spark, d):
    return T.method_spans(spark, d).select("method", diff.overlaps(F.col("start"), F.col("end"), F.lit(100), F.lit(300)).alias("meets"))


@query(
    f"""WITH {SPANS}, f AS (SELECT DISTINCT file, substr(file, -1)::INT % 2 = 0 AS added FROM spans), h AS (SELECT * FROM spans WHERE method % 5 = 0 AND substr(file, -1)::INT <> 3), c AS (SELECT * FROM spans WHERE method % 7 = 0 AND substr(file, -1)::INT <> 1),
  r AS (SELECT file, CASE WHEN added THEN 'current_added_file_all_methods' WHEN file IN (SELECT file FROM h) AND file IN (SELECT file FROM c) THEN 'strict_union_changed_methods' WHEN file IN (SELECT file FROM h) THEN 'strict_hits_only' WHEN file IN (SELECT file FROM c) THEN 'changed_methods_only' ELSE 'empty_no_selected_methods' END AS reason FROM f)
  SELECT DISTINCT x.file, name, s AS start, e AS "end", reason FROM (SELECT spans.*, 'm' AS k FROM spans UNION ALL SELECT *, 'h' FROM h UNION ALL SELECT *, 'c' FROM c) x JOIN r ON x.file = r.file
  WHERE (reason = 'current_added_file_all_methods' AND k = 'm') OR (k = 'h' AND reason IN ('strict_union_changed_methods', 'strict_hits_only')) OR (k = 'c' AND reason IN ('strict_union_changed_methods', 'changed_methods_only'))"""
)
def candidate_selection(spark, d):
    m = T.method_spans(spark, d)
    last = F.substring("file", -1, 1).cast("int")
    files = m.select("file", (last % 2 == 0).alias("added")).distinct()
    return affected.select_candidates(files, m, m.filter((F.col("method") % 5 == 0) & (last != 3)), m.filter((F.col("method") % 7 == 0) & (last != 1)))


@query(
    f"""WITH {SPANS}, t AS (SELECT file, name, cls || '::' || name AS long_name, s + 3 AS start, e + 3 AS "end", method AS id FROM spans),
  j AS (SELECT t.*, spans.method, row_number() OVER (PARTITION BY t.id ORDER BY (spans.cls = split_part(t.long_name, '::', 1))::INT DESC, (greatest(t.start, s) <= least(t."end", e))::INT DESC, abs(s - t.start), spans.method) AS n FROM t JOIN spans USING (file, name))
  SELECT DISTINCT file, name, long_name, start, "end", method FROM j WHERE n = 1"""
)
def fuzzy_method_match(spark, d):
    m = T.method_spans(spark, d)
    t = m.select("file", "name", F.concat_ws("::", "cls", "name").alias("long_name"), (F.col("start") + 3).alias("start"), (F.col("end") + 3).alias("end")).distinct()
    return affected.match_targets(t, m, ["file"])


@query(
    f"WITH {SPANS}, {LINES}, j AS (SELECT file, line, method, abs(s - line) AS distance, row_number() OVER (PARTITION BY file, line ORDER BY abs(s - line), method) AS n FROM lines JOIN spans USING (file)) SELECT file, line, method, distance FROM j WHERE n = 1"
)
def nearest_candidate(spark, d):
    lines = T.diff_lines(spark, d).withColumn("id", F.struct("file", "line"))
    m = T.method_spans(spark, d).select("file", "method", F.col("start").alias("m_start"))
    return affected.nearest(lines, m, ["file"], "line", "m_start", "method", "id").select("id.file", "id.line", "method", "distance")


@query(f"WITH {METHODS}, r AS (SELECT *, row_number() OVER (PARTITION BY commit_id, method_id ORDER BY cc, volume, nargs, nexits) AS n FROM methods) SELECT commit_id, method_id, cc, volume FROM r WHERE n = 1")
def affected_dedupe(spark, d):
    return affected.first_per_commit(T.method_rows(spark, d), ["commit_id", "method_id"], ["cc", "volume", "nargs", "nexits"]).select("commit_id", "method_id", "cc", "volume")


@query(
    f"""WITH {SPANS}, sites AS (SELECT method AS site, CASE WHEN method % 4 = 0 THEN method ELSE -1 END AS caller_id, CASE WHEN method % 4 = 3 THEN 'none' ELSE file END AS file, CASE WHEN method % 4 = 2 THEN '?' ELSE cls END AS cls, name, s + 2 AS line FROM spans),
  h AS (SELECT site, 1 AS tier, m.method, abs(m.s - line) AS far, m.file, m.s FROM sites JOIN spans m ON caller_id = m.method UNION ALL
        SELECT site, 2, m.method, abs(m.s - line), m.file, m.s FROM sites JOIN spans m ON sites.file = m.file AND sites.cls = m.cls AND sites.name = m.name UNION ALL
        SELECT site, 3, m.method, abs(m.s - line), m.file, m.s FROM sites JOIN spans m ON sites.file = m.file AND sites.name = m.name),
  r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY tier, far, file, s, method) AS n FROM h)
  SELECT site, tier, method AS caller FROM r WHERE n = 1"""
)
def caller_resolution(spark, d):
    m, k = T.method_spans(spark, d), F.col("method") % 4
    sites = m.select(
        F.col("method").alias("site"), F.when(k == 0, F.col("method")).otherwise(-1).alias("caller_id"), F.when(k == 3, "none").otherwise(F.col("file")).alias("file"), F.when(k == 2, "?").otherwise(F.col("cls")).alias("cls"), "name", (F.col("start") + 2).alias("line")
    )
    return calls.resolve_callers(sites, m)


@query(
    f"""WITH {SPANS}, m AS (SELECT file, method, CASE WHEN method % 3 = 0 THEN '' ELSE cls END AS cls, CASE WHEN method % 10 = 0 THEN 'only' || method ELSE name END AS name, s FROM spans),
  sites AS (SELECT c.method AS site, c.file, c.cls, c.s, t.name AS callee, CASE WHEN c.method % 5 = 0 THEN 'pkg.' || t.cls END AS inferred FROM m c JOIN m t ON t.method = (c.method * 7) % (SELECT count(*) FROM part) + 1),
  once AS (SELECT name FROM m GROUP BY name HAVING count(*) = 1),
  h AS (SELECT site, 1 AS tier, m.* FROM sites x JOIN m ON x.cls <> '' AND m.cls = x.cls AND m.file = x.file AND m.name = callee UNION ALL
        SELECT site, 2, m.* FROM sites x JOIN m ON m.file = x.file AND m.name = callee UNION ALL
        SELECT site, 3, m.* FROM sites x JOIN m ON m.cls <> '' AND m.cls = split_part(inferred, '.', 2) AND m.name = callee UNION ALL
        SELECT site, 11, m.* FROM sites x JOIN m ON m.name = callee WHERE callee IN (SELECT name FROM once)),
  r AS (SELECT h.*, row_number() OVER (PARTITION BY h.site ORDER BY tier, abs(h.s - x.s), h.file, h.s, h.method) AS n FROM h JOIN sites x ON h.site = x.site)
  SELECT site, tier, method AS callee FROM r WHERE n = 1"""
)
def callee_cascade(spark, d):
    k = F.col("method")
    m = T.method_spans(spark, d).select("file", "method", F.when(k % 3 == 0, "").otherwise(F.col("cls")).alias("cls"), F.when(k % 10 == 0, F.concat(F.lit("only"), k.cast("string"))).otherwise(F.col("name")).alias("name"), "start", F.lit("java").alias("language"))
    n = F.broadcast(m.agg(F.count(F.lit(1)).alias("n")))  # one row
    t = m.select(F.col("method").alias("t_id"), F.col("name").alias("callee"), F.col("cls").alias("t_cls"))
    c = m.join(n).withColumn("t_id", (k * 7) % F.col("n") + 1).join(t, "t_id")
    none = F.lit(None).cast("string")
    sites = c.select(F.col("method").alias("site"), "file", "cls", "start", "language", "callee", none.alias("receiver"), F.when(k % 5 == 0, F.concat(F.lit("pkg."), "t_cls")).alias("inferred"), none.alias("dotted"))
    return calls.resolve_callees(sites, m)


@query(f"WITH {SPANS}, m AS (SELECT method, CASE WHEN method % 10 = 0 THEN 'only' || method ELSE name END AS name FROM spans) SELECT name, min(method) AS method FROM m GROUP BY name HAVING count(*) = 1")
def unique_global_name(spark, d):
    k = F.col("method")
    return calls.unique_names(T.method_spans(spark, d).withColumn("name", F.when(k % 10 == 0, F.concat(F.lit("only"), k.cast("string"))).otherwise(F.col("name"))))


@query(
    "WITH e AS (SELECT DISTINCT l_suppkey AS a, l_partkey % 100 AS b FROM lineitem) SELECT s_suppkey AS node, (SELECT count(*) FROM e WHERE b = s_suppkey) AS in_coupling, (SELECT count(*) FROM e WHERE a = s_suppkey) AS out_coupling FROM supplier"
)
def degree_in_out(spark, d):
    return calls.degrees(T.load(spark, d, "supplier").select(F.col("s_suppkey").alias("node")), T.call_edges(spark, d))


@query("SELECT (SELECT count(DISTINCT p_partkey) FROM part) AS node_count, (SELECT count(DISTINCT p_brand) FROM part) AS file_count, (SELECT count(DISTINCT (l_suppkey, l_partkey % 100)) FROM lineitem) AS edge_count")
def graph_counts(spark, d):
    nodes = T.method_spans(spark, d).agg(F.count_distinct("method").alias("node_count"), F.count_distinct("file").alias("file_count"))
    return nodes.join(F.broadcast(T.call_edges(spark, d).agg(F.count_distinct("caller", "callee").alias("edge_count"))))  # one row each


@query(
    f"WITH {SPANS}, sp AS (SELECT file, s + 4 AS ss, e + 4 AS se, method::DOUBLE AS cyclomatic FROM spans), j AS (SELECT spans.method, cyclomatic, row_number() OVER (PARTITION BY spans.method ORDER BY abs(ss - s), ss, cyclomatic) AS n FROM spans JOIN sp ON spans.file = sp.file AND greatest(s, ss) <= least(e, se)) SELECT spans.method, cyclomatic FROM spans LEFT JOIN j ON spans.method = j.method AND n = 1"
)
def method_metric_asof(spark, d):
    m = T.method_spans(spark, d)
    spaces = m.select("file", (F.col("start") + 4).alias("start"), (F.col("end") + 4).alias("end"), F.col("method").cast("double").alias("cyclomatic"))
    return metrics.metric_space(m, spaces, ["file"], "method", ["cyclomatic"]).select("method", "cyclomatic")


@query(
    f"WITH {SPANS}, nodes AS (SELECT file, s - 2 AS ns, e + 2 AS ne, method AS node, e - s + 4 AS size FROM spans), j AS (SELECT spans.method, node, row_number() OVER (PARTITION BY spans.method ORDER BY size, node) AS n FROM spans JOIN nodes ON spans.file = nodes.file AND ns <= s AND ne >= e) SELECT method, node FROM j WHERE n = 1"
)
def smallest_enclosing_node(spark, d):
    m = T.method_spans(spark, d)
    nodes = m.select("file", (F.col("start") - 2).alias("start"), (F.col("end") + 2).alias("end"), F.col("method").alias("node"), (F.col("end") - F.col("start") + 4).alias("size"))
    return metrics.smallest_enclosing(m, nodes, ["file"], "method")


@query(
    """WITH s AS (SELECT l_orderkey AS id, list_distinct(list(l_partkey % 20)) AS refs, list_distinct(list(l_partkey % 20) FILTER (l_linenumber = 1)) AS loc, list_distinct(list(l_suppkey % 20)) AS fil FROM lineitem GROUP BY 1)
  SELECT id, CASE WHEN id % 2 = 0 THEN len(list_filter(refs, lambda x: list_contains(fil, x) AND NOT coalesce(list_contains(loc, x), false))) ELSE len(list_filter(refs, lambda x: NOT coalesce(list_contains(loc, x), false))) END AS global_var_count FROM s"""
)
def global_var_sets(spark, d):
    li = T.load(spark, d, "lineitem")
    r = F.col("l_partkey") % 20
    s = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(r).alias("refs"), F.collect_set(F.when(F.col("l_linenumber") == 1, r)).alias("loc"), F.collect_set(F.col("l_suppkey") % 20).alias("fil"))
    none = F.array().cast("array<bigint>")
    return s.select("id", metrics.global_count(F.col("refs"), F.col("loc"), F.col("fil"), none, none, F.col("id") % 2 == 0).alias("global_var_count"))


@query(
    """WITH s AS (SELECT l_orderkey AS id, count(DISTINCT l_partkey)::DOUBLE AS e1, count(DISTINCT l_suppkey)::DOUBLE AS e2, sum(l_quantity) AS n1, sum(l_linenumber)::DOUBLE AS n2 FROM lineitem GROUP BY 1),
  v AS (SELECT *, e1 + e2 AS vocabulary, n1 + n2 AS length, (n1 + n2) * log2(e1 + e2) AS volume, (e1 / 2) * n2 / e2 AS difficulty FROM s)
  SELECT id, round(vocabulary, 4) AS vocabulary, round(length, 4) AS length, round(volume, 4) AS volume, round(difficulty, 4) AS difficulty, round(difficulty * volume, 4) AS effort, round(difficulty * volume / 18, 4) AS time, round(pow(difficulty * volume, 2.0 / 3.0) / 3000, 6) AS bugs FROM v"""
)
def halstead_derived(spark, d):
    s = T.load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.count_distinct("l_partkey").alias("halstead_eta1"), F.count_distinct("l_suppkey").alias("halstead_eta2"), F.sum("l_quantity").alias("halstead_total1"), F.sum("l_linenumber").alias("halstead_total2")
    )
    h = metrics.halstead(s)
    return h.select("id", *[F.round(c, 4).alias(c) for c in ("vocabulary", "length", "volume", "difficulty", "effort", "time")], F.round("bugs", 6).alias("bugs"))


@query("SELECT 'p_name' AS field, count(p_name) AS hits, count(*) - count(p_name) AS misses, round(100.0 * count(p_name) / count(*), 4)::DOUBLE AS rate FROM part UNION ALL SELECT 'odd', count(*) FILTER (p_size % 2 = 1), count(*) FILTER (p_size % 2 = 0), round(100.0 * count(*) FILTER (p_size % 2 = 1) / count(*), 4)::DOUBLE FROM part")
def field_hit_rate(spark, d):
    return rounded(metrics.hit_rate(T.load(spark, d, "part").withColumn("odd", F.when(F.col("p_size") % 2 == 1, 1)), ["p_name", "odd"]), 4)


@query(f"WITH {IDX}, {WINDOWS} SELECT * FROM win")
def time_forward_windows(spark, d):
    return timeline.windows(T.commits(spark, d))


@query(
    f"""WITH {IDX}, {WINDOWS} SELECT dataset, window_id, train_start, train_end, test_start, test_end,
  count(*) FILTER (idx <= train_end) AS train_size, min(date) FILTER (idx <= train_end) AS train_start_date, max(date) FILTER (idx <= train_end) AS train_end_date,
  count(*) FILTER (idx >= test_start) AS test_size, min(date) FILTER (idx >= test_start) AS test_start_date, max(date) FILTER (idx >= test_start) AS test_end_date, true AS is_consecutive,
  count(DISTINCT label) FILTER (idx <= train_end) > 1 AND count(DISTINCT label) FILTER (idx >= test_start) > 1 AS used_for_modeling,
  CASE WHEN count(DISTINCT label) FILTER (idx <= train_end) < 2 THEN 'single_class_train' WHEN count(DISTINCT label) FILTER (idx >= test_start) < 2 THEN 'single_class_test' ELSE '' END AS skip_reason
  FROM idx JOIN win USING (dataset) WHERE idx BETWEEN train_start AND test_end GROUP BY ALL"""
)
def window_records(spark, d):
    rows = timeline.numbered(T.commits(spark, d))
    return timeline.records(rows, timeline.windows(rows))


@query(
    f"""WITH {IDX.replace("idx AS", "every AS")}, idx AS (SELECT e.dataset, commit_id, idx, date, CASE WHEN 10 * idx < 6 * c THEN 0 ELSE label END AS label FROM every e JOIN (SELECT dataset, count(*) AS c FROM every GROUP BY 1) USING (dataset)), {WINDOWS}
  SELECT dataset, window_id, count(DISTINCT label) FILTER (idx <= train_end) > 1 AND count(DISTINCT label) FILTER (idx >= test_start) > 1 AS used_for_modeling FROM idx JOIN win USING (dataset) WHERE idx BETWEEN train_start AND test_end GROUP BY ALL"""
)
def single_class_skip(spark, d):
    """The first six tenths of each dataset have one class, so its first windows are skipped."""
    rows = timeline.numbered(T.commits(spark, d))
    size = rows.groupBy("dataset").agg(F.count(F.lit(1)).alias("c"))
    rows = rows.join(F.broadcast(size), "dataset").withColumn("label", F.when(10 * F.col("idx") < 6 * F.col("c"), 0).otherwise(F.col("label"))).drop("c")
    return timeline.records(rows, timeline.windows(rows)).select("dataset", "window_id", "used_for_modeling")


_RANKS = f"{SAMPLES}, rk AS (SELECT *, rank() OVER (PARTITION BY dataset, feature ORDER BY x) + (count(*) OVER (PARTITION BY dataset, feature, x) - 1) / 2.0 AS r FROM samples), tie AS (SELECT dataset, feature, sum(t * (t - 1) / 2.0) AS ties FROM (SELECT dataset, feature, x, count(*) AS t FROM samples GROUP BY ALL) GROUP BY ALL), u AS (SELECT dataset, feature, sum(y)::DOUBLE AS n1, count(*) - sum(y)::DOUBLE AS n0, count(*)::DOUBLE AS n, (sum(r) FILTER (y = 1))::DOUBLE - sum(y) * (sum(y) + 1) / 2.0 AS u, corr(r, y) AS c FROM rk GROUP BY ALL)"


@query(f"WITH {_RANKS} SELECT dataset, feature, round(abs(c), 6) AS score FROM u")
def spearman_scores(spark, d):
    return rounded(scores.spearman(T.samples(spark, d), ["dataset", "feature"]))


@query(f"WITH {_RANKS} SELECT dataset, feature, round(abs((2 * u - n1 * n0) / sqrt((n * (n - 1) / 2 - ties::DOUBLE) * n1 * n0)), 6) AS score FROM u JOIN tie USING (dataset, feature)")
def kendall_scores(spark, d):
    return rounded(scores.kendall(T.samples(spark, d), ["dataset", "feature"]))


@query(f"WITH {_RANKS} SELECT dataset, feature, round(u / (n1 * n0), 6) AS auc FROM u")
def auc_rank(spark, d):
    return rounded(scores.auc(T.samples(spark, d), ["dataset", "feature"]))


_CONF = f"{COMMITS}, conf AS (SELECT dataset, count(*) FILTER (label = 0 AND x <= 200000) AS tn, count(*) FILTER (label = 0 AND x > 200000) AS fp, count(*) FILTER (label = 1 AND x <= 200000) AS fn, count(*) FILTER (label = 1 AND x > 200000) AS tp FROM commits GROUP BY 1)"


def _confusion(spark, d):
    return scores.confusion(T.commits(spark, d).withColumn("p", (F.col("x") > 200000).cast("int")), ["dataset"], "label")


@query(
    f"""WITH {_CONF}, r AS (SELECT *, coalesce(tp / nullif(tp + fn, 0), 0) AS r1, coalesce(tn / nullif(tn + fp, 0), 0) AS r0 FROM conf)
  SELECT dataset, tn, fp, fn, tp, round(sqrt(r1 * r0), 6) AS gmean, round((r1 + r0) / 2, 6) AS balanced_accuracy, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
  round(coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc, round(r1, 6) AS pd, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS pf, round(r0, 6) AS recall0, round(r1, 6) AS recall1 FROM r"""
)
def classification_metrics(spark, d):
    return rounded(scores.classifier_metrics(_confusion(spark, d)))


@query(f"WITH {_CONF} SELECT dataset, round(sqrt(coalesce(tp / nullif(tp + fn, 0), 0) * coalesce(tn / nullif(tn + fp, 0), 0)), 6) AS gmean FROM conf")
def gmean(spark, d):
    return rounded(scores.classifier_metrics(_confusion(spark, d)).select("dataset", "gmean"))


_SCORES_SQL = "sc AS (SELECT l_returnflag AS dataset, 'm' || l_partkey % 12 || '_' || ['mean', 'max', 'min', 'std'][l_linenumber % 4 + 1] AS feature, 'm' || l_partkey % 12 AS concept, max(l_extendedprice) AS score FROM lineitem GROUP BY ALL)"


def _scores(spark, d):
    stat = F.get(F.array(*map(F.lit, ("mean", "max", "min", "std"))), (F.col("l_linenumber") % 4).cast("int"))
    concept = F.concat(F.lit("m"), (F.col("l_partkey") % 12).cast("string"))
    return T.load(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("dataset"), F.concat_ws("_", concept, stat).alias("feature"), concept.alias("concept")).agg(F.max("l_extendedprice").alias("score"))


@query(f"WITH {_SCORES_SQL} SELECT dataset, concept, round(max(score), 4) AS score FROM sc GROUP BY ALL")
def max_pool_concept(spark, d):
    return rounded(rollup.max_pool(_scores(spark, d), ["dataset", "concept"]), 4)


@query(f"WITH {_SCORES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY dataset, concept ORDER BY score DESC, feature) AS n, count(*) OVER (PARTITION BY dataset, concept) AS members FROM sc) SELECT dataset, concept, feature AS representative, round(score, 4) AS score, members FROM r WHERE n = 1")
def max_pool_representative(spark, d):
    return rounded(rollup.max_pool_representative(_scores(spark, d), ["dataset", "concept"]), 4)


@query(f"WITH {_SCORES_SQL} SELECT dataset, concept, round(sum(score), 3) AS score FROM sc GROUP BY ALL")
def sum_importance(spark, d):
    return rounded(rollup.sum_importance(_scores(spark, d), ["dataset", "concept"], "score"), 3)


@query(f"WITH {_SCORES_SQL}, f AS (SELECT DISTINCT concept, feature FROM sc) SELECT concept, count(*) AS member_count, string_agg(feature, '|' ORDER BY feature) AS members FROM f GROUP BY 1")
def concept_members(spark, d):
    return rollup.members_by_concept(_scores(spark, d).select("concept", "feature").distinct())


_LOCAL_SQL = f"{_SCORES_SQL}, cs AS (SELECT dataset, concept, max(score) AS s FROM sc GROUP BY ALL), lr AS (SELECT dataset, concept, (dense_rank() OVER (PARTITION BY dataset ORDER BY floor(s / 500) DESC))::INT AS rank FROM cs)"
_META_SQL = f"{_LOCAL_SQL}, meta AS (SELECT concept, (dense_rank() OVER (ORDER BY floor(avg(rank))))::INT AS rank FROM lr GROUP BY 1)"


def _local(spark, d):
    s = rollup.max_pool(_scores(spark, d), ["dataset", "concept"])
    return s.select("dataset", "concept", F.dense_rank().over(Window.partitionBy("dataset").orderBy(F.desc(F.floor(F.col("score") / 500)))).alias("rank"))


def _meta(spark, d):
    m = _local(spark, d).groupBy("concept").agg(F.floor(F.avg("rank")).alias("m"))
    return m.select("concept", F.dense_rank().over(Window.orderBy("m")).alias("rank"))


@query(f"WITH {_LOCAL_SQL} SELECT concept, round(avg(rank), 6) AS average_rank, round(stddev_samp(rank), 6) AS rank_std, (dense_rank() OVER (ORDER BY avg(rank)))::INT AS consensus_rank FROM lr GROUP BY 1")
def consensus_rank(spark, d):
    return rounded(ranking.consensus(_local(spark, d)))


@query(f"WITH {_LOCAL_SQL} SELECT concept, count(*) AS dataset_count, count(*) FILTER (rank = 1) AS rank1_count, round(avg((rank = 1)::INT), 6) AS rank1_frequency, round(avg(rank), 6) AS mean_rank FROM lr GROUP BY 1")
def rank1_frequency(spark, d):
    return rounded(ranking.top_rank_frequency(_local(spark, d)))


@query(
    f"WITH {_META_SQL} SELECT lr.concept, count(*) AS dataset_count, count(*) FILTER (lr.rank = 1) AS rank1_count, round(avg((lr.rank = 1)::INT), 6) AS rank1_frequency, round(avg(lr.rank), 6) AS mean_rank, any_value(meta.rank) AS meta_rank FROM lr LEFT JOIN meta USING (concept) GROUP BY 1"
)
def rank_table_join(spark, d):
    return rounded(ranking.rank_table(_local(spark, d), _meta(spark, d).withColumnRenamed("rank", "meta_rank")))


@query(f"WITH {_META_SQL} SELECT 'local' AS scope, dataset, concept, rank FROM lr UNION ALL SELECT 'meta', 'all', concept, rank FROM meta")
def rank_long(spark, d):
    return ranking.rank_long(_local(spark, d), _meta(spark, d))


@query(f"WITH {_META_SQL}, g AS (SELECT concept, rank, dense_rank() OVER (ORDER BY rank) AS grp FROM meta), k AS (SELECT (10 * i)::INT AS k FROM range(1, 11) r(i)), t AS (SELECT max(grp) AS g FROM g) SELECT k AS topk_percent, concept, rank, least(g, greatest(1, ceil(g * k / 100.0)))::INT AS selected_rank_group_count FROM g, k, t WHERE grp <= least(g, greatest(1, ceil(g * k / 100.0)))")
def topk_rank_groups(spark, d):
    return ranking.top_groups(_meta(spark, d), list(range(10, 101, 10))).select("topk_percent", "concept", "rank", "selected_rank_group_count")


@query(f"WITH {_META_SQL} SELECT concept, rank, (row_number() OVER (ORDER BY rank, concept))::INT AS final_feature_rank FROM meta")
def final_feature_rank(spark, d):
    return ranking.final_rank(_meta(spark, d), ["rank", "concept"])


@query("SELECT l_returnflag AS experiment, l_linestatus AS dataset, round(avg(l_discount), 6) AS gmean_mean, round(stddev_samp(l_discount), 6) AS gmean_std, round(avg(l_tax), 6) AS mcc_mean, round(stddev_samp(l_tax), 6) AS mcc_std FROM lineitem GROUP BY ALL")
def performance_summary(spark, d):
    li = T.load(spark, d, "lineitem").select(F.col("l_returnflag").alias("experiment"), F.col("l_linestatus").alias("dataset"), F.col("l_discount").alias("gmean"), F.col("l_tax").alias("mcc"))
    return rounded(rollup.performance_summary(li, ["experiment", "dataset"], ["gmean", "mcc"]))


@query("SELECT l_returnflag AS experiment, round(median(l_extendedprice), 4) AS gmean, round(median(l_quantity), 4) AS mcc FROM lineitem GROUP BY ALL")
def median_across_datasets(spark, d):
    li = T.load(spark, d, "lineitem").select(F.col("l_returnflag").alias("experiment"), F.col("l_extendedprice").alias("gmean"), F.col("l_quantity").alias("mcc"))
    return rounded(rollup.median_across(li, ["experiment"], ["gmean", "mcc"]), 4)


@query("SELECT l_linestatus AS dataset, round(avg(l_tax) FILTER (l_returnflag = 'A'), 6) AS A, round(avg(l_tax) FILTER (l_returnflag = 'N'), 6) AS N, round(avg(l_tax) FILTER (l_returnflag = 'R'), 6) AS R FROM lineitem GROUP BY 1")
def metric_matrix_pivot(spark, d):
    li = T.load(spark, d, "lineitem").withColumnRenamed("l_linestatus", "dataset")
    return rounded(rollup.metric_matrix(li, "dataset", "l_returnflag", ["A", "N", "R"], "l_tax"))


@query(f"WITH {_SCORES_SQL} SELECT feature FROM sc GROUP BY feature HAVING count(DISTINCT dataset) = (SELECT count(DISTINCT dataset) FROM sc)")
def feature_intersection(spark, d):
    return ranking.common_features(_scores(spark, d))


@query("SELECT DISTINCT 'f' || p_partkey AS feature FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size % 4 = 0)")
def feature_missing(spark, d):
    p = T.load(spark, d, "part").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("feature"), "p_size")
    return tables.missing_features(p, p.filter("p_size % 4 = 0"))


@query("SELECT r_regionkey AS k, r_name AS name, NULL::INT AS region FROM region UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation")
def union_rows(spark, d):
    r = T.load(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    n = T.load(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return tables.union_rows([r, n])


@query("SELECT n_nationkey AS k, n_name AS name FROM nation")
def drop_pattern_columns(spark, d):
    n = T.load(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_name").alias("parent_name"), F.col("n_name").alias("diff_x"), F.col("n_name").alias("name_parent"))
    return tables.drop_matching(n)


@query("SELECT n_nationkey AS k, NULL::VARCHAR AS missing, n_name AS name FROM nation")
def fixed_schema(spark, d):
    n = T.load(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("k"), "n_regionkey")
    return tables.fixed_columns(n, {"k": "int", "missing": "string", "name": "string"})


@query(
    "SELECT unnest(['null_date', 'null_label', 'other_label', 'bad_x']) AS rule, unnest([count(*) FILTER (o_orderdate IS NULL), count(*) FILTER (o_orderkey % 50 = 0), count(*) FILTER (o_orderkey % 50 = 1), count(*) FILTER (o_orderkey % 9 = 0)]) AS violations FROM orders"
)
def validation_report(spark, d):
    k = F.col("commit_id")
    c = T.commits(spark, d).select("date", F.when(k % 50 == 1, 7).when(k % 50 != 0, F.col("label")).alias("label"), F.when(k % 9 != 0, F.col("x")).otherwise(float("inf")).alias("x"))
    return tables.validation_report(c, "date", "label", ["x"])


@query(f"WITH {IDX}, {WINDOWS} SELECT dataset, window_id, b::BIGINT AS bootstrap_id, (20260505 + window_id) AS tune_seed, ((20260505 + window_id) * 1000 + b) % 4294967295 AS fit_seed FROM win, range(1, 21) r(b)")
def seed_schedule(spark, d):
    w = timeline.windows(T.commits(spark, d)).withColumn("bootstrap_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(20).cast("long"))))
    tune = F.lit(20260505).cast("long") + F.col("window_id")
    return w.select("dataset", "window_id", "bootstrap_id", tune.alias("tune_seed"), P.normal_seed(tune * 1000 + F.col("bootstrap_id")).alias("fit_seed"))


_ROWS = "(SELECT l_orderkey AS commit_id, concat_ws('::', l_linenumber, l_partkey, l_suppkey) AS method_id, any_value(l_suppkey) AS file_path, min(l_quantity) AS q, min(l_extendedprice) AS x FROM lineitem GROUP BY ALL)"


def _affected_rows(spark, d):
    li = T.load(spark, d, "lineitem").withColumn("method_id", F.concat_ws("::", "l_linenumber", "l_partkey", "l_suppkey"))
    return li.groupBy(F.col("l_orderkey").alias("commit_id"), "method_id").agg(F.any_value("l_suppkey").alias("file_path"), F.min("l_quantity").alias("q"), F.min("l_extendedprice").alias("x"))


def _joined(spark, d):
    rows = _affected_rows(spark, d)
    own = rows.select("commit_id", "method_id", "q", "x")
    method = own.filter("q > 5").select("commit_id", "method_id", *[(F.col("q") * i + F.floor("x") % 7).alias(m) for i, m in enumerate(analyzer.METHOD_METRICS[2:-1], 1)])
    coupling = own.filter("q % 10 <> 0").select("commit_id", "method_id", (F.col("q") % 4).cast("long").alias("method_in_coupling"), (F.col("q") % 6).cast("long").alias("method_out_coupling"))
    globals_ = own.filter("q % 3 = 0").select("commit_id", "method_id", (F.col("q") % 5).alias("method_global_var_count"))
    files = rows.filter("file_path % 9 <> 0").groupBy("commit_id", "file_path").agg(*[(F.max("q") + i).alias(m) for i, m in enumerate(analyzer.FILE_METRICS)])
    return analyzer.function_rows(rows.select("commit_id", "method_id", "file_path"), method, files, coupling, globals_), files


_JOINED = f"""r AS {_ROWS}, f AS (SELECT commit_id, file_path, {", ".join(f"max(q) + {i} AS {m}" for i, m in enumerate(analyzer.FILE_METRICS))} FROM r WHERE file_path % 9 <> 0 GROUP BY ALL),
  j AS (SELECT r.commit_id, method_id, r.file_path, CASE WHEN q % 10 <> 0 THEN (q % 4)::BIGINT END AS method_in_coupling, CASE WHEN q % 10 <> 0 THEN (q % 6)::BIGINT END AS method_out_coupling,
    {", ".join(f"CASE WHEN q > 5 THEN q * {i} + floor(x) % 7 END AS {m}" for i, m in enumerate(analyzer.METHOD_METRICS[2:-1], 1))},
    CASE WHEN q % 3 = 0 THEN q % 5 ELSE 0 END AS method_global_var_count, {", ".join(analyzer.FILE_METRICS)} FROM r LEFT JOIN f ON r.commit_id = f.commit_id AND r.file_path = f.file_path)"""
_ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in (*analyzer.METHOD_METRICS[2:], *analyzer.FILE_METRICS))


@query(f"WITH {_JOINED} SELECT commit_id, method_id, file_path, method_in_coupling, method_out_coupling, {_ROUNDED} FROM j")
def function_row_join(spark, d):
    """Affected methods with metrics, coupling, globals and file metrics, each of which some lack."""
    return rounded(_joined(spark, d)[0])


_EACH = lambda ms: ", ".join(f"round(avg({m}), 6) AS current_{m}_mean, round(max({m}), 6)::DOUBLE AS current_{m}_max, round(min({m}), 6)::DOUBLE AS current_{m}_min, round(stddev_pop({m}), 6) AS current_{m}_std" for m in ms)


@query(
    f"""WITH {_JOINED}, a AS (SELECT commit_id, {_EACH(analyzer.METHOD_METRICS)}, count(DISTINCT method_id) AS modified_method_count_current, count(DISTINCT method_id) > 0 AS has_modified_methods_current FROM j GROUP BY 1),
  b AS (SELECT commit_id, {_EACH(analyzer.FILE_METRICS)} FROM f GROUP BY 1),
  n AS (SELECT l_orderkey AS commit_id, count(*) FILTER (l_returnflag = 'A') AS current_new_file_count, count(*) FILTER (l_returnflag = 'A') / count(*)::DOUBLE AS current_new_file_ratio FROM lineitem GROUP BY 1),
  t AS (SELECT commit_id, count(DISTINCT (file_path, method_id)) AS class_touched_count_current FROM j GROUP BY 1),
  w AS (SELECT o_orderkey AS commit_id, o_orderdate AS commit_author_date, a.* EXCLUDE (commit_id, modified_method_count_current, has_modified_methods_current), b.* EXCLUDE (commit_id), coalesce(modified_method_count_current, 0) AS modified_method_count_current, coalesce(has_modified_methods_current, false) AS has_modified_methods_current,
    coalesce(current_new_file_count, 0) AS current_new_file_count, round(coalesce(current_new_file_ratio, 0), 6) AS current_new_file_ratio, coalesce(class_touched_count_current, 0) AS class_touched_count_current
    FROM orders LEFT JOIN a ON o_orderkey = a.commit_id LEFT JOIN b ON o_orderkey = b.commit_id LEFT JOIN n ON o_orderkey = n.commit_id LEFT JOIN t ON o_orderkey = t.commit_id)
  SELECT *, {" AND ".join(f"current_{m}_mean IS NOT NULL" for m in (*analyzer.METHOD_METRICS, *analyzer.FILE_METRICS))} AS is_complete_feature FROM w"""
)
def commit_feature_rows(spark, d):
    """The commit table: 18 method and 4 file metrics, new files, classes and completeness."""
    functions, files = _joined(spark, d)
    commits = T.load(spark, d, "orders").select(F.col("o_orderkey").alias("commit_id"), F.col("o_orderdate").alias("commit_author_date"))
    changes = T.load(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit_id"), F.when(F.col("l_returnflag") == "A", "ADD").otherwise("MODIFY").alias("change_type"), F.lit("a").alias("old_path"), F.lit("b").alias("new_path"))
    out = analyzer.commit_rows(commits, functions, files, changes, functions.select("commit_id", F.col("file_path").alias("file"), F.col("method_id").alias("cls")))
    return out.select(*[F.round(F.col(c).cast("double"), 6).alias(c) if c.endswith(("_mean", "_max", "_min", "_std", "_ratio")) else F.col(c) for c in out.columns])


@query(f"WITH {COMMITS} SELECT commit_id, date, label, author % 3 = 0 OR author % 4 > 1 AS is_merge FROM commits ORDER BY commit_id LIMIT 500 OFFSET 100")
def commit_scan_merge(spark, d):
    """A commit scan that skips 100 and takes 500 (the feature itself), with the merge predicate."""
    c = T.commits(spark, d).withColumn("parents", F.array_repeat(F.lit("p"), (F.col("author") % 4).cast("int")))
    return c.orderBy("commit_id").offset(100).limit(500).select("commit_id", "date", "label", ((F.col("author") % 3 == 0) | (F.size("parents") > 1)).alias("is_merge"))


@query()
def mutual_info(spark, d):
    return scores.mutual_information(T.samples(spark, d), ["dataset", "feature"])


@query()
def npsk_rank(spark, d):
    s = T.load(spark, d, "lineitem").select(F.col("l_returnflag").alias("dataset"), F.concat(F.lit("m"), (F.col("l_quantity") / 10).cast("int").cast("string")).alias("concept"), F.col("l_extendedprice").alias("score"))
    return ranking.rank_clusters(s, ["dataset"])


def _forest_rows(spark, d):
    c = T.commits(spark, d)
    month = F.month("date").cast("double")
    return c.withColumns({"size": F.col("x"), "la": F.col("x") * F.col("label") + F.col("author"), "month_mean": month})


@query()
def rf_mdi(spark, d):
    """Forest importances per window of every dataset: the stage as it is, with its full grid and 20 bootstraps."""
    from gleaner.plans import stages

    return stages.forest(_forest_rows(spark, d), ["size", "la", "month_mean"])["raw_mdi"]


@query()
def bootstrap_sample(spark, d):
    """Rows by class before and after a stratified bootstrap."""
    from gleaner.operators import model

    rows = timeline.numbered(T.commits(spark, d))
    return model.bootstrap(rows.withColumn("idx", F.col("commit_id")), 7).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("commit_id").alias("distinct_rows"))
