"""Snapshots, statistics and commits derived from the test tables, each as a DataFrame and as the same SQL."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import content_hash, meta_hash
from ..shared import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Refs of the repository below: snapshots base and ours, and a branch with a staged removal.
FIRST, SECOND, STAGED = "base", "ours", "staged"
_repositories: dict[tuple, object] = {}


def place(spark: SparkSession, label: str) -> str:
    """A new local path of the shared folder."""
    return f"{shared_dir(spark).removeprefix('file://')}/{label}-{uuid.uuid4().hex}"


def repository(spark: SparkSession, sf_dir: str):
    """A repository whose main branch has nothing, base, ours, and ours again; made once for a session and folder."""
    from ..repository import Repository

    key = spark.sparkContext.applicationId, sf_dir
    if key not in _repositories or not os.path.isdir(_repositories[key].root):
        repo = Repository.init(spark, place(spark, "repository"))
        for message, rows, name in (("nothing", None, None), ("all", base(spark, sf_dir), FIRST), ("edits", ours(spark, sf_dir), SECOND)):
            repo._commit_entries(repo.store.empty() if rows is None else rows, message, "commit")
            if name:
                repo.branch(name)
        repo.branch("side")
        repo.branch(STAGED)
        repo.checkout(STAGED)
        repo.rm(["src1"])
        repo.checkout("side")
        repo._commit_entries(ours(spark, sf_dir), "more", "commit")
        repo.checkout("main")
        repo.merge("side")
        _repositories[key] = repo
    return _repositories[key]


def _path():
    return F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".txt"))


def _none():
    return F.lit(None).cast("string")


def _id(n: int):
    return F.col("doc_id") % n


def _entries(docs: DataFrame, path=None, text=None) -> DataFrame:
    """Entries of a documents table, each text a stored file."""
    path, data = _path() if path is None else path, (F.col("text") if text is None else text).cast("binary")
    rows = docs.select("doc_id", path.alias("path"), content_hash(data).alias("hash"), F.octet_length(data).cast("long").alias("size"))
    return rows.select("path", "hash", "size", F.col("doc_id").alias("mtime_ns"), F.lit("content").alias("identity_mode"), F.col("hash").alias("blob_hash"), _none().alias("source_uri"), _none().alias("footer"))


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(table(spark, sf_dir, "documents"))


def ours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth removed, a tenth edited, a tenth renamed."""
    docs = table(spark, sf_dir, "documents").filter(_id(10) != 1)
    text = F.when(_id(10) == 2, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    return _entries(docs, F.when(_id(10) == 3, F.concat(F.lit("new/"), _path())).otherwise(_path()), text)


def theirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits that conflict with ours, a removal, edits alone, and edits of what ours removed."""
    docs = table(spark, sf_dir, "documents").filter(_id(10) != 4)
    text = F.when(_id(20) == 2, F.concat("text", F.lit("y"))).when((_id(10) == 5) | (_id(20) == 11), F.concat("text", F.lit("z"))).otherwise(F.col("text"))
    return _entries(docs, text=text)


def half_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base with odd documents known by path and size alone."""
    odd = F.col("mtime_ns") % 2 == 1
    entries = base(spark, sf_dir)
    pick = lambda meta, c: F.when(odd, meta).otherwise(F.col(c)).alias(c)
    return entries.select("path", pick(meta_hash(F.col("path"), F.col("size")), "hash"), "size", "mtime_ns", pick(F.lit("meta"), "identity_mode"), pick(_none(), "blob_hash"), pick(F.concat(F.lit("mem://"), "path"), "source_uri"), "footer")


def source_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_uri, digest, n_bytes of the bytes that half_meta's sources hold."""
    return base(spark, sf_dir).filter(F.col("mtime_ns") % 2 == 1).select(F.concat(F.lit("mem://"), "path").alias("source_uri"), F.col("hash").alias("digest"), F.col("size").alias("n_bytes"))


#: Staged removals (a directory and a file's parent) and what the stage adds.
REMOVED = ["src1", "src2/en"]


def staged_additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replacements, new paths that sort first, and additions below a removed directory."""
    docs = table(spark, sf_dir, "documents").filter(_id(25) == 0)
    path = F.when(_id(3) == 0, _path()).when(_id(3) == 1, F.concat(F.lit("0/"), _path())).otherwise(F.concat(F.lit("src1/added/"), F.col("doc_id").cast("string")))
    return _entries(docs, path, F.concat("text", F.lit("+")))


def row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RG_STATS as if lineitem had row groups of 500 order keys, ten to a file, with a part of the line numbers null."""
    items = table(spark, sf_dir, "lineitem").withColumn("g", F.floor(F.col("l_orderkey") / 500).cast("int")).withColumn("line", F.when(F.col("l_linenumber") != 1, F.col("l_linenumber")))
    lanes = {"l_orderkey": ("l", "l_orderkey"), "l_quantity": ("d", "l_quantity"), "l_returnflag": ("s", "l_returnflag"), "line": ("l", "line")}
    null = lambda kind: F.lit(None).cast({"l": "long", "d": "double", "s": "string", "b": "boolean"}[kind])

    def of(name: str):
        kind, column = lanes[name]
        values = {f"{m}_{k}": (F.col(f"{column}_{m}").cast({"l": "long", "d": "double", "s": "string"}[k]) if k == kind else null(k)) for k in "ldsb" for m in ("min", "max")}
        return F.struct(F.lit(name).alias("col"), F.lit(kind).alias("typ"), *(v.alias(k) for k, v in values.items()), F.col(f"{column}_nulls").alias("nulls"), F.lit(True).alias("exact"))

    columns = [c for _, c in lanes.values()]
    measures = [f(c).alias(f"{c}_{n}") for c in columns for n, f in (("min", F.min), ("max", F.max), ("nulls", lambda c: F.count_if(F.col(c).isNull())))]
    groups = items.groupBy("g").agg(F.count(F.lit(1)).alias("rows"), *measures)
    file = F.floor(F.col("g") / 10).cast("int")
    return groups.select(F.format_string("lineitem/%04d.parquet", file).alias("path"), F.sha2(file.cast("string"), 256).alias("footer"), (F.col("g") % 10).alias("rg"), "rows", F.explode(F.array(*map(of, lanes))).alias("c")).select("path", "footer", "rg", "rows", "c.*")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit for each order: chains of 50, and every tenth commit merges the one seven before it too."""
    n = F.col("o_orderkey")
    parents = F.filter(F.array(F.when(n % 50 != 0, n - 1), F.when(n % 10 == 9, n - 7)), lambda p: p.isNotNull())
    return table(spark, sf_dir, "orders").select(n.cast("string").alias("id"), F.transform(parents, lambda p: p.cast("string")).alias("parents"), (n % 50).cast("int").alias("generation"), F.concat(F.lit("commit "), n.cast("string")).alias("message"))


SQL_PATH = "source || '/' || lang || '/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.txt'"


def _sql_entries(where: str = "true", path: str = SQL_PATH, text: str = "text") -> str:
    return f"SELECT path, sha256(t) AS hash, CAST(octet_length(encode(t)) AS BIGINT) AS size, doc_id AS mtime_ns, 'content' AS identity_mode, sha256(t) AS blob_hash, CAST(NULL AS VARCHAR) AS source_uri, CAST(NULL AS VARCHAR) AS footer FROM (SELECT doc_id, {path} AS path, {text} AS t FROM documents WHERE {where})"


SQL = {
    "base": _sql_entries(),
    "ours": _sql_entries("doc_id % 10 <> 1", f"CASE WHEN doc_id % 10 = 3 THEN 'new/' || {SQL_PATH} ELSE {SQL_PATH} END", "CASE WHEN doc_id % 10 = 2 THEN text || 'x' ELSE text END"),
    "theirs": _sql_entries("doc_id % 10 <> 4", text="CASE WHEN doc_id % 20 = 2 THEN text || 'y' WHEN doc_id % 10 = 5 OR doc_id % 20 = 11 THEN text || 'z' ELSE text END"),
    "additions": _sql_entries("doc_id % 25 = 0", f"CASE WHEN doc_id % 3 = 0 THEN {SQL_PATH} WHEN doc_id % 3 = 1 THEN '0/' || {SQL_PATH} ELSE 'src1/added/' || CAST(doc_id AS VARCHAR) END", "text || '+'"),
    "half_meta": "SELECT path, CASE WHEN mtime_ns % 2 = 1 THEN sha256(path || chr(10) || CAST(size AS VARCHAR)) ELSE hash END AS hash, size, mtime_ns, CASE WHEN mtime_ns % 2 = 1 THEN 'meta' ELSE 'content' END AS identity_mode, CASE WHEN mtime_ns % 2 = 1 THEN NULL ELSE hash END AS blob_hash, CASE WHEN mtime_ns % 2 = 1 THEN 'mem://' || path END AS source_uri, footer FROM base",
    "rg": "SELECT g, CAST(count(*) AS BIGINT) AS rows, min(l_orderkey) AS ok_min, max(l_orderkey) AS ok_max, min(l_quantity) AS q_min, max(l_quantity) AS q_max, min(l_returnflag) AS f_min, max(l_returnflag) AS f_max, min(line) AS ln_min, max(line) AS ln_max, count(*) - count(line) AS ln_nulls FROM (SELECT *, l_orderkey // 500 AS g, CASE WHEN l_linenumber <> 1 THEN l_linenumber END AS line FROM lineitem) GROUP BY g",
    "commits": "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey AS n, CASE WHEN o_orderkey % 50 <> 0 THEN o_orderkey - 1 END AS p1, CASE WHEN o_orderkey % 10 = 9 THEN o_orderkey - 7 END AS p2, CAST(o_orderkey % 50 AS INTEGER) AS generation FROM orders",
}


def sql(*names: str, body: str) -> str:
    """body with the named fixtures, and base where others need it, as common table expressions."""
    wanted = (["base"] if "half_meta" in names and "base" not in names else []) + list(names)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({SQL[n]})" for n in wanted) + " " + body
