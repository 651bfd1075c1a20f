"""Text artifacts, manifests, source maps, saved inventories and scope rules."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triage import schemas
from triage.functions.tags import present
from triage.functions.text import redact, redact_struct
from triage.sources.file_hash import PIECE, local_path, sha256_by_pieces


def _suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def read_artifacts(spark: SparkSession, root: str, suffixes: list[str]) -> DataFrame:
    """(source_file, suffix, text) of every file below ``root`` with one of the suffixes.

    The glob makes Spark skip other files before opening them.
    """
    globs = ",".join("*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes)
    return (spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="{" + globs + "}")
            .select(F.col("_metadata.file_path").alias("source_file"),
                    _suffix(F.col("_metadata.file_path")).alias("suffix"), F.col("value").alias("text")))


#: Bytes that a cell can hold.
LARGEST = (1 << 31) - 1 - 1024
ANY_SIZE = (1 << 63) - 1
TOO_LARGE = "Larger than 2 GiB; not hashed."


def hash_manifest(spark: SparkSession, root: str, glob: str = "*", largest: int = LARGEST, piece: int = PIECE) -> DataFrame:
    """(path, size_bytes, sha256, not_hashed) per file; a file over ``largest`` bytes is not opened and has a reason instead of a hash.

    Mounted files of more than ``piece`` bytes are hashed by pieces. In a store that only Spark reads a file goes into one cell, so there
    one over ``LARGEST`` bytes always has the reason.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", glob).load(root))
    piece = min(piece, LARGEST)
    # names and sizes, from the listing
    long = [(r.path, r.length) for r in files.where((F.col("length") > piece) & (F.col("length") <= largest)).select("path", "length").collect()]
    mounted = all(local_path(path) for path, _ in long)
    if not mounted:
        largest = piece = min(largest, LARGEST)
    hashed = manifest_of(files.where(F.col("length") <= min(piece, largest)))
    if long and mounted:
        hashed = hashed.unionByName(sha256_by_pieces(spark, long, piece))
    return hashed.withColumn("not_hashed", F.lit("")).unionByName(files.where(F.col("length") > largest).select(
        "path", F.col("length").alias("size_bytes"), F.lit(None).cast("string").alias("sha256"), F.lit(TOO_LARGE).alias("not_hashed")))


def manifest_of(files: DataFrame) -> DataFrame:
    """Manifest of any (path, content) table."""
    return files.select("path", F.length("content").cast("bigint").alias("size_bytes"),
                        F.sha2(F.col("content"), 256).alias("sha256"))


def _keys(text: Column) -> Column:
    opens = text.rlike(r"^\s*+\{")
    return F.coalesce(F.when(opens, F.json_object_keys(text)), F.array().cast("array<string>"))


def _all(keys: Column, *names: str) -> Column:
    wanted = F.array(*[F.lit(n) for n in names])
    return F.size(F.array_intersect(keys, wanted)) == len(names)


def _any(keys: Column, *names: str) -> Column:
    return F.arrays_overlap(keys, F.array(*[F.lit(n) for n in names]))


def classify_inputs(artifacts: DataFrame) -> DataFrame:
    """Input type of each artifact and the analyses that apply to it."""
    text, suffix, keys = F.col("text"), F.col("suffix"), F.col("top_keys")
    low = F.lower(text)
    start = F.ltrim(text)
    methods = r"^(?:GET|POST|PUT|PATCH|DELETE|OPTIONS|HEAD) "
    structured = F.when(suffix.isin(".json", ".yml", ".yaml"), F.when(
        _all(keys, "endpoints") & _any(keys, "source_files", "project_name"), "endpoint_inventory")
        .when(_any(keys, "secrets", "source_maps", "storage_references"), "frontend_inventory")
        .when(_any(keys, "jwt_observations", "cookie_observations", "cors_observations"), "auth_surface_inventory")
        .when(_any(keys, "operations", "schema_artifacts", "review_leads"), "graphql_inventory")
        .when(_all(keys, "terms", "categories"), "vocabulary_inventory")
        .when(_all(keys, "actors", "objects", "expected_access"), "authz_matrix")
        .when(_any(keys, "evidence_items"), "evidence_workspace")
        .when(_all(keys, "artifacts", "assets", "triage_leads"), "correlation_project"))
    kind = F.coalesce(
        structured,
        F.when(suffix == ".har", "har").when(suffix.isin(".js", ".mjs", ".cjs"), "javascript")
        .when(suffix.isin(".html", ".htm"), "html").when(suffix.isin(".graphql", ".gql"), "graphql")
        .when(suffix == ".map", "source_map")
        .when(suffix.isin(".txt", ".http"), F.when(start.startswith("HTTP/"), "raw_response")
              .when(start.rlike(methods), "raw_request").otherwise("text"))
        .when(suffix == ".json", "json").when(suffix.isin(".yml", ".yaml"), "yaml").otherwise("unknown"))
    k = F.col("input_type")
    mentions = low.contains("graphql")
    modules = present(
        (k == "har", "har"), (k.isin("javascript", "html", "source_map"), "frontend"),
        (k.isin("har", "javascript", "html"), "endpoints"), (k.isin("har", "raw_response", "raw_request"), "auth_surface"),
        (k.isin("endpoint_inventory", "frontend_inventory", "auth_surface_inventory", "graphql_inventory",
                "vocabulary_inventory", "authz_matrix", "evidence_workspace", "correlation_project"), "correlation"),
        (k.isin("har", "javascript", "html", "graphql", "source_map", "text", "json", "yaml", "endpoint_inventory",
                "frontend_inventory"), "vocabulary"),
        (k == "endpoint_inventory", "authorization"),
        ((k == "graphql") | ((k == "har") & mentions)
         | ((k == "javascript") & (mentions | low.contains("query ") | low.contains("mutation "))), "graphql"),
        (k == "evidence_workspace", "report_quality"), (k.isin("raw_response", "raw_request"), "evidence"))
    return (artifacts.withColumn("top_keys", F.when(suffix.isin(".json", ".yml", ".yaml"), _keys(text))
                                 .otherwise(F.array().cast("array<string>")))
            .withColumn("input_type", kind)
            .select("source_file", "input_type", modules.alias("analyses")))


def graphql_bearing(artifacts: DataFrame) -> DataFrame:
    """The inputs of the GraphQL analysis: schema and document files, captures that mention it, scripts that mention it or an operation."""
    low, suffix = F.lower("text"), F.col("suffix")
    mentions = low.contains("graphql")
    return artifacts.where(suffix.isin(".graphql", ".gql") | ((suffix == ".har") & mentions) | (
        suffix.isin(".js", ".mjs", ".cjs") & (mentions | low.contains("query ") | low.contains("mutation "))))


def detect_artifact_type(artifacts: DataFrame) -> DataFrame:
    """Type of a saved result by its top-level keys; the first rule that fits wins."""
    keys, suffix = F.col("top_keys"), F.col("suffix")
    name = F.lower(F.substring_index("source_file", "/", -1))
    kind = (F.when(suffix.isin(".md", ".markdown"), "markdown_report")
            .when(_all(keys, "endpoints", "hosts"), "endpoint_inventory")
            .when(_all(keys, "operations", "schema_artifacts"), "graphql_inventory")
            .when(_all(keys, "jwt_observations", "cookie_observations"), "auth_surface_inventory")
            .when(_all(keys, "secrets", "source_maps"), "frontend_inventory")
            .when(_all(keys, "terms", "routes") | _all(keys, "terms", "categories"), "vocabulary_inventory")
            .when(_all(keys, "actors", "objects", "expectations") | _all(keys, "actors", "objects", "expected_access"),
                  "authz_matrix")
            .when(_all(keys, "evidence_items", "reproduction_steps"), "evidence_workspace")
            .when(_all(keys, "title", "severity", "asset"), "finding")
            .when(name.contains("har") | _any(keys, "har_findings", "sensitive_findings"), "har_report")
            .when(suffix == ".json", "json_report").otherwise("unknown"))
    return (artifacts.withColumn("top_keys", _keys(F.col("text")))
            .select("source_file", kind.alias("artifact_type")))


def read_source_maps(artifacts: DataFrame) -> DataFrame:
    """(source_file, idx, source, content, evidence) per listed source of each source map."""
    m = F.from_json("text", schemas.SOURCE_MAP, schemas.JSON_LIMITS)
    # no filter on m: Catalyst would copy it, with the parsing, down to the table's own splits; what has no sources explodes to nothing
    parsed = artifacts.select("source_file", m.alias("m"))
    root = F.coalesce(F.col("m.sourceRoot"), F.lit(""))
    evidence = F.concat(F.lit("sourceRoot="), root, F.lit("; sources="), F.size("m.sources"))
    pairs = F.arrays_zip("m.sources", F.coalesce("m.sourcesContent", F.array().cast("array<string>")).alias("c"))
    # sourcesContent may be the longer list; only listed sources count
    listed = F.slice(pairs, F.lit(1), F.size("m.sources"))
    return (parsed.select("source_file", evidence.alias("evidence"), F.posexplode(listed).alias("idx", "p"))
            .select("source_file", "idx", F.col("p")["sources"].alias("source"),
                    F.coalesce(F.col("p")["c"], F.lit("")).alias("content"), "evidence"))


def expand_sources(source_maps: DataFrame) -> DataFrame:
    """Embedded sources as artifacts of their own, for a second scan."""
    return (source_maps.filter("content != ''")
            .select(F.col("source").alias("source_file"), _suffix(F.col("source")).alias("suffix"),
                    F.col("content").alias("text")))


def read_inventory(spark: SparkSession, path: str, kind: str, fmt: str = "parquet") -> DataFrame:
    """An already computed inventory table, with its declared schema."""
    return spark.read.schema(schemas.struct(kind)).format(fmt).load(path)


def write_inventory(tables: dict[str, DataFrame], path: str, fmt: str = "parquet", mode: str = "errorifexists"):
    """Write each table of an inventory below ``path``, redacted field by field first."""
    for name, table in tables.items():
        redact_struct(table).write.mode(mode).format(fmt).save(f"{path}/{name}")


# ---- inventories that grow with their inputs ------------------------------------------------------------------------------
#
# A root holds one folder per table and run, and one manifest per run: (path, sha256) of the inputs that the run scanned, written last.
# A run without a manifest never counts, so one that ended early is simply repeated.

_MANIFEST = "path string, sha256 string, run bigint"
#: Changed texts that one task scans: a join's tasks are sized by the bytes they read, but scanning takes far longer than reading.
TEXTS_A_TASK = 10_000


def _manifests(spark: SparkSession, root: str) -> DataFrame:
    """(path, sha256, run): the newest entry of every input."""
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], _MANIFEST)
    rows = spark.read.schema("path string, sha256 string").option("basePath", f"{root}/manifest").parquet(f"{root}/manifest/*")
    rows = rows.withColumn("run", F.regexp_extract("_metadata.file_path", r"/run=(\d+)/", 1).cast("bigint"))
    newest = rows.groupBy("path").agg(F.max("run").alias("run"))
    return rows.join(newest, ["path", "run"]).select("path", "sha256", "run").distinct()


def changed_inputs(inputs: DataFrame, root: str) -> DataFrame:
    """The rows of a manifest (path, sha256) that no run has scanned, or only with another content."""
    known = _manifests(inputs.sparkSession, root)
    return inputs.join(known.select("path", "sha256"), ["path", "sha256"], "left_anti")


def update_inventory(inputs: DataFrame, texts: DataFrame, scan, root: str) -> None:
    """Scan what changed and publish it.

    ``inputs`` is the manifest of the texts (path, sha256), ``texts`` has them by source_file, and ``scan`` maps texts to a dict of tables
    with a source_file column.  Nothing is scanned or published if nothing changed.
    """
    spark = inputs.sparkSession
    # what changed is worked out once, with its hashes of whole texts, and read by the count, the join and the manifest
    kept = f"{root}/_todo-{uuid.uuid4().hex}"
    try:
        changed_inputs(inputs.select("path", "sha256"), root).distinct().write.parquet(kept)
        _scan_changed(spark.read.schema("path string, sha256 string").parquet(kept), texts, scan, root)
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(kept)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _scan_changed(todo: DataFrame, texts: DataFrame, scan, root: str) -> None:
    spark = todo.sparkSession
    count = todo.count()
    if not count:
        return
    run = (_manifests(spark, root).agg(F.max("run")).first()[0] or 0) + 1
    changed = texts.join(todo.select(F.col("path").alias("source_file")), "source_file", "left_semi")
    changed = changed.repartition(max(spark.sparkContext.defaultParallelism, -(-count // TEXTS_A_TASK)))
    for name, table in scan(changed).items():
        redact_struct(table).write.mode("overwrite").parquet(f"{root}/{name}/run={run}")
    todo.write.mode("overwrite").parquet(f"{root}/manifest/run={run}")


def reload_inventory(inputs: DataFrame, root: str, name: str) -> DataFrame:
    """The rows of one table that belong to the inputs as they are now; inputs without a run give none."""
    spark = inputs.sparkSession
    current = inputs.select("path", "sha256").join(_manifests(spark, root), ["path", "sha256"]).select(F.col("path").alias("source_file"), "run")
    rows = spark.read.option("basePath", f"{root}/{name}").parquet(f"{root}/{name}")
    return rows.join(current.distinct(), ["source_file", "run"], "left_semi").drop("run")


def write_wordlists(lists: DataFrame, path: str, fmt: str = "text", mode: str = "errorifexists"):
    """(list, term) rows to one folder per list, as text, csv or json."""
    # by range, so that a long list is written by many tasks
    out = lists.select("list", "term").repartitionByRange("list", "term").sortWithinPartitions("list", "term")
    writer = out.write.mode(mode).partitionBy("list")
    {"text": writer.text, "csv": lambda p: writer.csv(p, header=True), "json": writer.json}[fmt](path)


def scope_rules(spark: SparkSession, path: str) -> DataFrame:
    """(kind, ord, rule) from a JSON scope profile, rules in their written order."""
    profile = spark.read.schema("in_scope array<string>, out_of_scope array<string>").json(path, multiLine=True)
    return profile_rules(profile)


def profile_rules(profiles: DataFrame) -> DataFrame:
    out = profiles.select(F.lit("out").alias("kind"), F.posexplode("out_of_scope").alias("ord", "rule"))
    return out.unionByName(profiles.select(F.lit("in").alias("kind"), F.posexplode("in_scope").alias("ord", "rule")))


def evidence_items(files: DataFrame) -> DataFrame:
    """Hash, size, type, sensitivity and redacted text of evidence files (path, content).

    Text of any size is scanned and kept, without NUL bytes and only if it is valid UTF-8.  What isn't scanned says why in not_scanned
    and has no contains_sensitive_data.
    """
    content = F.col("content")
    valid = F.try_validate_utf8(content.cast("string"))
    reason = (F.when(content.isNull(), "No content.").when(valid.isNull(), "Not valid UTF-8.").when(F.contains(valid, F.lit("\x00")), "Holds NUL bytes.")
              .otherwise(""))
    return (files.withColumn("not_scanned", reason).withColumn("t", F.when(F.col("not_scanned") == "", valid).otherwise(""))
            .select("path", F.substring_index("path", "/", -1).alias("title"),
                    F.length(content).cast("bigint").alias("size_bytes"), F.sha2(content, 256).alias("sha256"),
                    F.concat(F.lit("Local file ("), F.length(content), F.lit(" bytes)")).alias("description"),
                    "not_scanned", F.col("t"), redact(F.col("t")).alias("redacted_evidence_text"))
            .select("path", "title", "size_bytes", "sha256", "description", "not_scanned",
                    F.when(F.col("not_scanned") == "", F.col("t") != F.col("redacted_evidence_text")).alias("contains_sensitive_data"),
                    "redacted_evidence_text"))
