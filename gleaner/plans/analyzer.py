"""From a git repository to three tables: methods, files and commits with the metrics of what each commit changed.

The commits' snapshots are joined with files that are parsed once per distinct content and path; impacted lines select the
affected methods; call sites are resolved inside each snapshot, which gives the coupling of its methods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import paths as P
from gleaner.operators import affected, calls, diff, metrics, rollup, tables
from gleaner.sources import measures
from gleaner.sources.gitlog import GitSource

#: The metrics of methods and files that commits are described by.
METHOD_METRICS = (
    "method_in_coupling",
    "method_out_coupling",
    "method_cc",
    "method_halstead",
    "method_halstead_eta1",
    "method_halstead_eta2",
    "method_halstead_total1",
    "method_halstead_total2",
    "method_halstead_length",
    "method_halstead_vocabulary",
    "method_halstead_volume",
    "method_halstead_difficulty",
    "method_halstead_effort",
    "method_halstead_bugs",
    "method_halstead_time",
    "method_nargs",
    "method_nexits",
    "method_global_var_count",
)
FILE_METRICS = ("file_cloc", "file_mi", "file_nom", "file_class")
#: Columns of the method table, in order.
FUNCTION_COLUMNS = (
    {"commit_id": "string", "commit_author_date": "timestamp", "snapshot_scope": "string", "snapshot_commit_id": "string", "is_merge_commit": "boolean", "method_coupling_available": "boolean"}
    | {"method_id": "string", "file_path": "string", "class_name": "string", "method_name": "string", "start_line": "int", "end_line": "int"}
    | {"method_in_coupling": "bigint", "method_out_coupling": "bigint", "old_path": "string", "new_path": "string", "language": "string", "node_count": "bigint", "file_count": "bigint", "token_count": "int"}
    | {m: "double" for m in METHOD_METRICS[2:]}
    | {m: "double" for m in FILE_METRICS}
)
#: Languages whose globals are told by declared scopes; others count all names that aren't local.
SPECIALISED = ("c", "cpp", "csharp", "python", "java", "javascript", "typescript", "tsx")


def _read(spark: SparkSession, repo: str, table: str, **options) -> DataFrame:
    reader = spark.read.format("git").option("repo", repo).option("table", table)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()


def _inside(commit: Column, name: Column) -> Column:
    return F.concat_ws("\x1f", commit, name)


def function_rows(rows: DataFrame, method_metrics: DataFrame, file_metrics: DataFrame, coupling: DataFrame, global_counts: DataFrame) -> DataFrame:
    """Affected methods with their metrics, coupling and globals by (commit_id, method_id) and their files' metrics by (commit_id, file_path); no globals count 0."""
    by_method = ["commit_id", "method_id"]
    out = rows.join(method_metrics, by_method, "left").join(coupling, by_method, "left").join(global_counts, by_method, "left").join(file_metrics, ["commit_id", "file_path"], "left")
    return out.withColumn("method_global_var_count", F.coalesce(F.col("method_global_var_count").cast("double"), F.lit(0.0)))


def commit_rows(commits: DataFrame, functions: DataFrame, files: DataFrame, changes: DataFrame, classes: DataFrame) -> DataFrame:
    """One row a commit: statistics of 18 method and 4 file metrics, counts, and whether any is missing."""
    by = "commit_id"
    out = commits.select(by, "commit_author_date")
    parts = (rollup.with_files(rollup.commit_rollup(functions, list(METHOD_METRICS)), files, list(FILE_METRICS)), rollup.new_files(changes), rollup.touched_classes(classes))
    for part in parts:
        out = out.join(part, by, "left")
    out = out.fillna(0, ["modified_method_count_current", "current_new_file_count", "current_new_file_ratio", "class_touched_count_current"]).fillna(False, ["has_modified_methods_current"])
    return rollup.complete(out)


def analyze(spark: SparkSession, repo: str, languages: list[str] | None = None, skip: int = 0, limit: int | None = None) -> dict[str, DataFrame]:
    """Tables `function`, `file` and `commit` of a repository, for the given languages (none: all known ones)."""
    spark.dataSource.register(GitSource)
    window = {"skip": skip} | ({"limit": limit} if limit is not None else {})
    languages = P.detected_order(languages or list(P.SUFFIXES))
    commits = _read(spark, repo, "commits", **window).persist()
    changes = _read(spark, repo, "file_changes", **window).persist()
    files = _read(spark, repo, "snapshot_files", **window).withColumn("language", P.language_of(F.col("path"), languages)).filter("language IS NOT NULL").persist()
    # Only what the snapshots hold is parsed, once per content and path; blobs come from the whole history, since a snapshot may be older than the window.
    texts = _read(spark, repo, "blobs").dropDuplicates(["blob_sha"])
    parsed = measures.measured(files.select("path", "blob_sha", "language").distinct().join(texts, "blob_sha")).persist()
    snapshots = files.select("commit_id", "path", "blob_sha").join(parsed, ["path", "blob_sha"])

    m = snapshots.select("commit_id", F.col("path").alias("file"), "language", F.explode("methods").alias("m")).select("commit_id", "file", "language", "m.*")
    m = m.withColumn("method_id", P.method_id(F.col("file"), F.col("cls"), F.col("name"), F.col("start"))).withColumn("at", _inside(F.col("commit_id"), F.col("file"))).persist()

    changed = changes.filter("new_path IS NOT NULL").withColumn("at", _inside(F.col("commit_id"), F.col("new_path")))
    spans = m.select("at", "name", "start", "end", "method_id")
    own = diff.parse_unified(changed).select("at", F.explode("added").alias("x")).select("at", F.col("x.line").alias("line")).distinct()
    hits = diff.methods_on_lines(spans, diff.impacted_lines(changed, ["at"]), on="at")
    edited = diff.methods_on_lines(spans, own, on="at")
    added = changed.select("at", P.is_added(F.col("change_type"), F.col("old_path"), F.col("new_path")).alias("added")).distinct()
    chosen = affected.select_candidates(added, spans, hits, edited, key="at").select("at", "name", "start", "end").distinct()
    touched = m.join(chosen, ["at", "name", "start", "end"]).dropDuplicates(["commit_id", "method_id"]).persist()

    sites = snapshots.select("commit_id", F.col("path").alias("file"), "language", F.explode("calls").alias("c"), F.xxhash64("commit_id", "path").alias("h"))
    sites = sites.select("commit_id", "file", "language", F.col("c.caller_cls").alias("cls"), F.col("c.caller_start").alias("start"), "c.caller", "c.callee", "c.receiver", "c.inferred", "c.dotted").distinct()
    caller = P.method_id(F.col("file"), F.col("cls"), F.col("caller"), F.col("start"))
    sites = sites.withColumn("caller_id", _inside(F.col("commit_id"), caller)).withColumn("site", F.struct("caller_id", "callee", "receiver", "inferred", "dotted"))
    nodes = m.select("commit_id", _inside(F.col("commit_id"), F.col("method_id")).alias("method"), "file", "cls", "name", "start", "language")
    imports = snapshots.select("commit_id", F.col("path").alias("file"), F.explode("imports").alias("i")).select("commit_id", "file", "i.alias", "i.target")
    found = calls.resolve_callees(sites, nodes, imports, within=["commit_id"])
    edges = found.select(F.col("site.caller_id").alias("caller"), "callee")
    degree = calls.degrees(nodes.select(F.col("method").alias("node")), edges)
    key = F.split("node", "\x1f")
    coupling = degree.select(key[0].alias("commit_id"), key[1].alias("method_id"), F.col("in_coupling").alias("method_in_coupling"), F.col("out_coupling").alias("method_out_coupling"))
    graph = nodes.groupBy("commit_id").agg(F.count_distinct("method").alias("node_count"), F.count_distinct("file").alias("file_count"))

    derived = metrics.halstead(touched)
    values = {f"method_{k}": F.col(k).cast("double") for k in ("cc", "halstead_eta1", "halstead_eta2", "halstead_total1", "halstead_total2", "nargs", "nexits")}
    values |= {f"method_halstead_{k}": F.col(k) for k in ("length", "vocabulary", "volume", "difficulty", "effort", "bugs", "time")}
    values["method_halstead"] = F.col("volume")
    method_metrics = derived.select("commit_id", "method_id", *[c.alias(k) for k, c in values.items()])
    symbols = metrics.global_count(F.col("refs"), F.col("locals"), F.col("file_symbols"), F.col("class_symbols"), F.col("declared"), F.col("language").isin(*SPECIALISED))
    global_counts = touched.select("commit_id", "method_id", symbols.alias("method_global_var_count"))

    classes = rollup.classes_by_file(m, file="at").withColumnRenamed("at", "_at")
    mi = measures.maintainability(F.col("file_length"), F.col("file_vocabulary"), F.col("file_cc"), F.col("sloc"))
    by_file = snapshots.select("commit_id", F.col("path").alias("file_path"), "language", F.col("cloc").cast("double").alias("file_cloc"), mi.alias("file_mi"), F.col("nom").cast("double").alias("file_nom"), _inside(F.col("commit_id"), F.col("path")).alias("_at"))
    modified = changed.select("commit_id", F.col("new_path").alias("file_path"), "old_path", "new_path").distinct()
    by_file = modified.join(by_file, ["commit_id", "file_path"]).join(classes, "_at", "left").withColumn("file_class", F.coalesce(F.col("file_class").cast("double"), F.lit(0.0))).drop("_at").persist()

    rows = touched.select("commit_id", "method_id", F.col("file").alias("file_path"), F.col("cls").alias("class_name"), F.col("name").alias("method_name"), F.col("start").alias("start_line"), F.col("end").alias("end_line"), "token_count")
    about = commits.select("commit_id", "commit_author_date", F.col("is_merge").alias("is_merge_commit"))
    function = function_rows(rows, method_metrics, by_file, coupling, global_counts).join(about, "commit_id").join(graph, "commit_id", "left")
    function = function.withColumns({"snapshot_scope": F.lit("current"), "snapshot_commit_id": F.col("commit_id"), "method_coupling_available": F.lit(True)})
    file = by_file.join(about, "commit_id").withColumns({"snapshot_scope": F.lit("current"), "metric_scope": F.lit("file")})
    commit = commit_rows(commits, function, by_file, changes, touched.select("commit_id", "file", "cls"))
    return {"function": tables.fixed_columns(function, FUNCTION_COLUMNS), "file": file, "commit": commit}


def run(spark: SparkSession, repo: str, base: str, fmt: str = "csv", **options) -> None:
    """Analyses a repository and writes its three tables."""
    got = analyze(spark, repo, **options)
    tables.write_tables(got["function"], got["file"], got["commit"], base, fmt)
