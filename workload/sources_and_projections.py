"""Sources, sinks, projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortscope.functions.outcomes import flag_if
from cohortscope.functions.vectors import columns_with_prefix, pack_array, unpack_array
from cohortscope.operators.evaluation import with_outcome
from cohortscope.operators.projection import (
    drop_sentinels,
    in_list,
    map_values,
    max_bound,
    to_numeric,
)
from cohortscope.session import scratch_dir
from cohortscope.sources.catalog import (
    by_extension,
    exclude_paths,
    file_catalog,
    file_catalog_by_folder,
    files_per_folder,
    first_file_per_folder,
    folder_summary,
)
from cohortscope.sources.sinks import memoize, write_by_label, write_cases
from cohortscope.sources.tables import (
    inline_cases,
    normalize_headers,
    null_if_missing,
    read_cases,
    read_indexed_csv,
    read_json_map,
)
from workload.base import (
    CUTOFF,
    FLAGGED_SQL,
    SCANS_SQL,
    flagged,
    query,
    rounded,
    scans,
    table,
)

PAGE_PATHS_SQL = "regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '^https?:/', '')"


def page_paths(spark, sf_dir):
    """Page addresses as file paths."""
    plain = F.regexp_replace(F.regexp_extract("url", r"^[^?#]*", 0), "^https?:/", "")
    return table(spark, sf_dir, "pages").select("page_id", plain.alias("path"))


@query(
    "read_cases",
    """SELECT doc_id, lang, CASE WHEN source IN ('src1', 'src2') THEN NULL ELSE source END AS source,
              'a, "' || lang || '" b' AS quoted, CAST(n_chars AS DOUBLE) AS size
       FROM documents""",
)
def read_cases_query(spark, sf_dir):
    """CSV round trip: quoted commas, doubled quotes, sentinel texts to NULL."""
    path = scratch_dir(spark, "cases")
    source = F.when(F.col("source") == "src1", "missing").when(F.col("source") == "src2", "None")
    written = table(spark, sf_dir, "documents").select(
        "doc_id",
        "lang",
        source.otherwise(F.col("source")).alias("source"),
        F.concat(F.lit('a, "'), "lang", F.lit('" b')).alias("quoted"),
        F.col("n_chars").cast("double").alias("size"),
    )
    write_cases(written, path)
    return read_cases(spark, path, written.schema)


@query("read_indexed_csv", "SELECT c_custkey, c_mktsegment FROM customer")
def read_indexed_csv_query(spark, sf_dir):
    """CSV with a leading row index."""
    path = scratch_dir(spark, "indexed")
    indexed = table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") * 7).alias("row"), "c_custkey", "c_mktsegment"
    )
    write_cases(indexed, path)
    return read_indexed_csv(spark, path, indexed.schema)


@query(
    "read_json_map",
    """SELECT 'event-' || event_id AS series, CAST(json_extract(props, '$.k') AS BIGINT) AS k
       FROM events""",
)
def read_json_map_query(spark, sf_dir):
    """One JSON object per line, keyed by series."""
    path = scratch_dir(spark, "annotations")
    line = F.concat(F.lit('{"event-'), "event_id", F.lit('": '), "props", F.lit("}"))
    table(spark, sf_dir, "events").select(line.alias("value")).write.mode("overwrite").text(path)
    schema = T.StructType([T.StructField("k", T.LongType())])
    return read_json_map(spark, path, schema).select("series", F.col("annotation.k").alias("k"))


def text_tree(spark, sf_dir):
    """Texts as up to nine files per language and source, under a new folder."""
    path = scratch_dir(spark, "tree")
    texts = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    dealt = texts.repartitionById(9, (F.col("doc_id") % 9).cast("int"))
    dealt.select("lang", "source", "text").write.partitionBy("lang", "source").text(path)
    return path


@query(
    "file_catalog",
    "SELECT lang, source, CAST(count(DISTINCT doc_id % 9) AS INTEGER) AS n_files FROM documents GROUP BY 1, 2",
)
def file_catalog_query(spark, sf_dir):
    """Write the texts into several files per language and source, then list the tree."""
    path = text_tree(spark, sf_dir)
    listed = file_catalog(spark, path, "*.txt", levels=["lang", "source"])
    return listed.groupBy(
        F.substring_index("lang", "=", -1).alias("lang"),
        F.substring_index("source", "=", -1).alias("source"),
    ).agg(F.count(F.lit(1)).cast("int").alias("n_files"))


@query(
    "file_catalog_by_folder",
    "SELECT lang, count(DISTINCT (source, doc_id % 9)) AS n_files FROM documents GROUP BY lang",
)
def file_catalog_by_folder_query(spark, sf_dir):
    """The same tree listed by tasks, one folder name at a time."""
    path = text_tree(spark, sf_dir)
    folders = table(spark, sf_dir, "documents").select(F.concat(F.lit("lang="), "lang").alias("folder"))
    listed = file_catalog_by_folder(folders, path, "*.txt", levels=["lang"])
    return listed.groupBy(F.substring_index("lang", "=", -1).alias("lang")).agg(
        F.count(F.lit(1)).alias("n_files")
    )


@query(
    "first_file_per_folder",
    f"""WITH {SCANS_SQL}
        SELECT regexp_replace(path, '/[^/]*$', '') AS folder, min(path) AS first_file
        FROM scans GROUP BY 1""",
)
def first_file_per_folder_query(spark, sf_dir):
    return first_file_per_folder(scans(spark, sf_dir))


@query(
    "files_per_folder",
    f"""WITH {SCANS_SQL}
        SELECT regexp_replace(path, '/[^/]*$', '') AS folder, count(*) AS n_files
        FROM scans GROUP BY 1""",
)
def files_per_folder_query(spark, sf_dir):
    return files_per_folder(scans(spark, sf_dir))


@query(
    "exclude_paths",
    f"SELECT page_id, {PAGE_PATHS_SQL} AS path FROM pages "
    f"WHERE {PAGE_PATHS_SQL} NOT IN ('/ththre.example.com/fr/825', '/LICENSE')",
)
def exclude_paths_query(spark, sf_dir):
    return exclude_paths(page_paths(spark, sf_dir), ["/ththre.example.com/fr/825", "/LICENSE"])


@query(
    "by_extension",
    f"SELECT page_id, {PAGE_PATHS_SQL} AS path FROM pages "
    f"WHERE ends_with({PAGE_PATHS_SQL}, '.html') ORDER BY path",
)
def by_extension_query(spark, sf_dir):
    return by_extension(page_paths(spark, sf_dir), ".html")


@query(
    "normalize_headers",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'missing' ELSE event_type END AS kernel,
              coalesce(CASE WHEN value > 10 THEN CAST(user_id AS VARCHAR) END, 'missing') AS thickness,
              'missing' AS orientation
       FROM events""",
)
def normalize_headers_query(spark, sf_dir):
    """Absent tags, present or not as columns, become ``missing``."""
    headers = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("kernel"),
        F.when(F.col("value") > 10, F.col("user_id")).alias("thickness"),
    )
    return normalize_headers(headers, ["kernel", "thickness", "orientation"])


@query(
    "inline_cases",
    """SELECT kind, count(event_id) AS n
       FROM (VALUES ('click'), ('view'), ('absent')) t(kind)
       LEFT JOIN events ON kind = event_type GROUP BY kind""",
)
def inline_cases_query(spark, sf_dir):
    """Literal ids looked up in a table."""
    wanted = inline_cases(spark, [("click",), ("view",), ("absent",)], "kind string")
    events = table(spark, sf_dir, "events")
    counted = events.groupBy("event_type").agg(F.count("event_id").alias("n"))
    joined = wanted.join(counted, F.col("kind") == F.col("event_type"), "left")
    return joined.select("kind", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "write_cases",
    "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders",
)
def write_cases_query(spark, sf_dir):
    path = scratch_dir(spark, "sink")
    kept = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"
    )
    write_cases(kept, path)
    return spark.read.schema(kept.schema).option("header", True).csv(path)


@query(
    "memoize",
    "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1",
)
def memoize_query(spark, sf_dir):
    """The second call finds the stored table and does not build."""
    path = scratch_dir(spark, "memo")
    orders = table(spark, sf_dir, "orders")
    memoize(spark, path, lambda: orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")))
    return memoize(spark, path, lambda: 1 / 0)


@query(
    "write_by_label",
    f"""WITH {FLAGGED_SQL}
        SELECT outcome, count(*) AS n FROM (
          SELECT CASE WHEN label = 1 THEN CASE WHEN tied_score >= {CUTOFF} THEN 'TP' ELSE 'FN' END
                      ELSE CASE WHEN tied_score >= {CUTOFF} THEN 'FP' ELSE 'TN' END END AS outcome
          FROM flagged) GROUP BY 1""",
)
def write_by_label_query(spark, sf_dir):
    path = scratch_dir(spark, "sorted")
    labelled = with_outcome(flagged(spark, sf_dir), "label", "tied_score", CUTOFF)
    write_by_label(labelled, path)
    return spark.read.parquet(path).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


# --- projections and filters -----------------------------------------------------------------


@query("select", "SELECT o_custkey, o_orderkey, o_orderdate FROM orders")
def select_query(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")


@query("drop_columns", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def drop_columns_query(spark, sf_dir):
    return table(spark, sf_dir, "orders").drop("o_totalprice", "o_orderdate", "o_orderpriority")


@query("rename", "SELECT doc_id AS pid, quality AS event, toxic FROM labels")
def rename_query(spark, sf_dir):
    return table(spark, sf_dir, "labels").withColumnsRenamed({"doc_id": "pid", "quality": "event"})


@query(
    "cast",
    """SELECT CAST(o_orderkey AS VARCHAR) AS order_text, CAST(o_custkey AS INTEGER) AS customer,
              CAST(o_orderdate AS DATE) AS day FROM orders""",
)
def cast_query(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("order_text"),
        F.col("o_custkey").cast("int").alias("customer"),
        F.col("o_orderdate").cast("date").alias("day"),
    )


@query(
    "to_numeric_coerce",
    """SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 2 + CAST(o_orderkey % 2 AS INTEGER) * -1)
              AS DOUBLE) AS level FROM orders""",
)
def to_numeric_query(spark, sf_dir):
    """Half the texts are numbers, half are not."""
    text = F.expr("substring(o_orderpriority, 1, 2 + cast(o_orderkey % 2 as int) * -1)")
    return table(spark, sf_dir, "orders").select("o_orderkey", to_numeric(text).alias("level"))


@query(
    "filter_all",
    """SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
       WHERE l_quantity = 25 AND l_returnflag = 'R' AND l_linestatus = 'F'""",
)
def filter_all_query(spark, sf_dir):
    return (
        table(spark, sf_dir, "lineitem")
        .filter(
            (F.col("l_quantity") == 25)
            & (F.col("l_returnflag") == "R")
            & (F.col("l_linestatus") == "F")
        )
        .select("l_orderkey", "l_linenumber", "l_extendedprice")
    )


@query(
    "drop_sentinels",
    """SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem
       WHERE l_returnflag NOT IN ('A', 'N')""",
)
def drop_sentinels_query(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return drop_sentinels(lines, ["l_returnflag"], ["A", "N"])


@query(
    "null_if_missing",
    """SELECT l_linestatus, count(*) AS n, count(kernel) AS n_kernel FROM (
         SELECT l_linestatus, CASE WHEN l_returnflag IN ('A', 'N') THEN NULL ELSE l_returnflag END AS kernel
         FROM lineitem) GROUP BY 1""",
)
def null_if_missing_query(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_linestatus", "l_returnflag")
    marked = null_if_missing(lines, ["A", "N"], columns=["l_returnflag"])
    return marked.groupBy("l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.count("l_returnflag").alias("n_kernel")
    )


@query("max_bound", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity <= 3")
def max_bound_query(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return max_bound(lines, "l_quantity", 3)


@query("exclude_value", "SELECT event_id, event_type FROM events WHERE event_type <> 'error'")
def exclude_value_query(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return events.filter(F.col("event_type") != "error")


@query("keep_value", "SELECT event_id, event_type FROM events WHERE event_type = 'click'")
def keep_value_query(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return events.filter(F.col("event_type") == "click")


@query(
    "in_list",
    "SELECT event_id, event_type, value FROM events WHERE event_type IN ('click', 'view', 'other')",
)
def in_list_query(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return in_list(events, "event_type", ["click", "view", "other"])


@query(
    "null_predicates",
    """SELECT d.doc_id, lang, 'ungraded' AS state FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
       WHERE quality IS NULL
       UNION ALL SELECT d.doc_id, lang, 'graded' FROM documents d JOIN labels l ON d.doc_id = l.doc_id
       WHERE quality IS NOT NULL""",
)
def null_predicates_query(spark, sf_dir):
    """Rows with and rows without a value."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang")
    joined = documents.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    absent = joined.filter(F.col("quality").isNull()).withColumn("state", F.lit("ungraded"))
    present = joined.filter(F.col("quality").isNotNull()).withColumn("state", F.lit("graded"))
    return absent.unionByName(present).select("doc_id", "lang", "state")


@query(
    "pack_array",
    """SELECT vec_id, p - 1 AS place, round(CAST(embedding[p] AS DOUBLE), 6) AS value, 64 AS width
       FROM embeddings, range(1, 65) t(p)""",
)
def pack_array_query(spark, sf_dir):
    """Unpack an array to wide columns, pick them by prefix, pack them again."""
    vectors = table(spark, sf_dir, "embeddings")
    wide = vectors.select("vec_id", *unpack_array(F.col("embedding"), "feature_", 64))
    packed = wide.select("vec_id", pack_array(columns_with_prefix(wide, "feature_")).alias("packed"))
    placed = packed.select(
        "vec_id", F.posexplode("packed").alias("place", "value"), F.size("packed").alias("width")
    )
    return placed.withColumn("value", F.round(F.col("value").cast("double"), 6))


@query(
    "unpack_array",
    "SELECT vec_id, "
    + ", ".join(f"round(CAST(embedding[{i + 1}] AS DOUBLE), 6) AS feature_{i}" for i in range(64))
    + " FROM embeddings",
)
def unpack_array_query(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    wide = vectors.select("vec_id", *unpack_array(F.col("embedding"), "feature_", 64))
    names = columns_with_prefix(wide, "feature_")
    return wide.select("vec_id", *[rounded(F.col(c).cast("double"), 6, c) for c in names])


@query(
    "with_literal",
    """SELECT doc_id, 'graded' AS dataset_name, CAST(NULL AS DOUBLE) AS pred_risk_year_0 FROM labels""",
)
def with_literal_query(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(
        "doc_id",
        F.lit("graded").alias("dataset_name"),
        F.lit(None).cast("double").alias("pred_risk_year_0"),
    )


@query(
    "fill_null",
    """SELECT d.doc_id, coalesce(quality, 0) AS quality
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def fill_null_query(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    documents = table(spark, sf_dir, "documents").select("doc_id")
    return documents.join(labels, "doc_id", "left").fillna(0, ["quality"])


@query(
    "flag_if",
    """SELECT d.doc_id, CASE WHEN lang = 'en' AND quality > 0 THEN 1 ELSE 0 END AS event
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def flag_if_query(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").join(
        table(spark, sf_dir, "labels"), "doc_id", "left"
    )
    flag = flag_if((F.col("lang") == "en") & (F.col("quality") > 0))
    return joined.select("doc_id", flag.alias("event"))


@query(
    "map_values",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'blue' WHEN 'view' THEN 'red' END AS color
       FROM events""",
)
def map_values_query(spark, sf_dir):
    color = map_values(F.col("event_type"), {"click": "blue", "view": "red"})
    return table(spark, sf_dir, "events").select("event_id", color.alias("color"))


@query(
    "folder_summary",
    f"""WITH {SCANS_SQL}
        SELECT pid, scan_year, count(DISTINCT scan) AS n_scans, bool_or(kernel = 'R') AS any_annotation
        FROM scans GROUP BY 1, 2""",
)
def folder_summary_query(spark, sf_dir):
    marked = scans(spark, sf_dir).withColumn("annotated", F.col("kernel") == "R")
    return folder_summary(marked, ["pid", "scan_year"], "scan", "annotated")
