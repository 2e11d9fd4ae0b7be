"""Catalogue tables derived from the driver's tables, for the registered queries; the same definitions in DuckDB SQL for the oracles.

Integer arithmetic only, so both engines agree. "Now" is 2024-01-31 00:00:00 wherever an operator takes a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import FOLDERS, category_to_bucket, infer_category
from ..functions.text import FINDINGS

NOW = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    folder = _pick(["templates", "regulations", "internal-policies", "examples", "misc"], i % 5)
    status = F.when(i % 13 == 0, "failed").when(i % 13 == 1, "needs_ocr").when(i % 13 == 2, "needs_doc_conversion").when(i % 13 == 3, "pending").otherwise("indexed")
    out = d.select(
        i.alias("document_id"),
        folder.alias("folder"),
        F.concat(F.lit("local://"), folder, F.lit("/"), F.col("source"), F.lit("/"), i.cast("string"), F.lit(".txt")).alias("source_uri"),
        F.concat(F.lit("doc-"), i.cast("string")).alias("title"),
        F.col("text").alias("content"),
        "n_chars",
        (1 + i % 3).cast("int").alias("current_version"),
        (i % 11 != 0).alias("is_active"),
        status.alias("status"),
        F.timestamp_seconds(F.lit(1704067200) + i * 37 % 100000).alias("updated_at"),
    )
    bad = F.col("status").isin("failed", "needs_ocr", "needs_doc_conversion")
    return out.withColumns(
        {"category": infer_category(F.substring("source_uri", 9, 1 << 20), FOLDERS), "error_message": F.when(bad, F.concat(F.lit("could not read: "), F.col("status")))}
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    i = F.col("document_id")
    rows = d.withColumn("version", F.explode(F.sequence(F.lit(1), F.col("current_version") + (i % 7 == 0).cast("int"))))
    real = chunks(spark, sf_dir).groupBy("file_id").agg(F.count("*").cast("int").alias("n"))
    name = F.concat(i.cast("string"), F.lit(".txt"))
    path = F.when(i % 17 == 0, F.concat(F.lit("C:\\legacy\\"), name)).otherwise(F.concat(i.cast("string"), F.lit("/v"), F.col("version").cast("string"), F.lit("/"), name))
    out = rows.select(
        (i * 10 + F.col("version")).alias("file_id"),
        "document_id",
        "version",
        category_to_bucket(F.col("category")).alias("storage_bucket"),
        path.alias("storage_path"),
        name.alias("original_filename"),
        F.sha2(F.col("content").cast("binary"), 256).alias("sha256"),
        F.col("n_chars").alias("size_bytes"),
        F.when(F.col("version") > F.col("current_version"), "pending").otherwise(F.col("status")).alias("status"),
        "updated_at",
    )
    return out.join(real, "file_id", "left").withColumn("chunk_count", (F.coalesce("n", F.lit(0)) + (i % 19 == 0).cast("int")).cast("int")).drop("n")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, d = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    v = F.col("vec_id")
    doc = F.floor(v / 5)
    version = (1 + v % 3).cast("int")
    rows = e.select(
        v.alias("chunk_id"),
        doc.alias("document_id"),
        F.when(v % 89 != 0, version).alias("version"),
        F.floor(v % 5 / 3).cast("int").alias("chunk_index"),
        (doc * 10 + version).alias("file_id"),
        F.when(v % 97 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding")).alias("embedding"),
    )
    # chunks of a document hold fifths of its text, the whole of it between them
    part, size = (F.col("chunk_id") % 5).cast("int"), F.ceil(F.char_length("text") / 5).cast("int")
    texts = d.select(F.col("doc_id").alias("document_id"), "text")
    return rows.join(texts, "document_id").withColumn("content", F.substring(F.col("text"), part * size + 1, size)).drop("text")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), "text")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with their vectors; those with a number below zero have no direction, so that they find nothing."""
    e = table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0")
    blank = e.where("vec_id % 500 = 0").select((-F.col("vec_id") - 1).alias("request_id"), F.transform("embedding", lambda x: x * 0).alias("embedding"))
    return e.select(F.col("vec_id").alias("request_id"), "embedding").union(blank)


#: category, k, threshold, how many go into the evidence
SPEC = [("templates", 5, 0.20, 3), ("internal_policies", 8, 0.25, 6), ("national_regulations", 8, 0.25, 6)]


def spec(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SPEC, "category string, k int, threshold double, cap int")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    kind = F.col("event_type")
    status = F.when(kind.isin("signup", "purchase"), "pending").when(kind == "view", "processing").when(kind == "click", "done").otherwise("failed")
    return e.select(
        i.alias("job_id"),
        (F.col("user_id") * 10 + 1).alias("file_id"),
        status.alias("status"),
        (50 + 50 * (i % 4)).cast("int").alias("priority"),
        F.col("ts").alias("scheduled_at"),
        F.when(i % 3 != 0, F.col("ts")).alias("claimed_at"),
        (i % 6).cast("int").alias("attempts"),
        F.lit(5).alias("max_attempts"),
    )


#: Letter types of our own: type, order, label, keywords, fields.
CATALOGUE = [
    ("notice", 1, "Notice", ["the", "and", "of"], ["recipient_name", "subject"]),
    ("request", 2, "Request", ["to", "of", "in"], ["recipient_name"]),
    ("reply", 3, "Reply", ["la", "le", "de"], ["subject"]),
    ("report", 4, "Report", ["und", "der", "to"], ["period"]),
    ("general", 5, "Letter", [], []),
]


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOGUE, "type string, ord int, label string, keywords array<string>, fields array<string>")


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    i = F.col("doc_id")
    tag = lambda n: F.concat(F.lit(" [source: doc-"), ((i + n) % 40).cast("string"), F.lit(" v1 #"), (n % 3).cast("string"), F.lit("]"))
    lines = F.transform(F.split("text", "\n"), lambda line, n: F.when(n % 3 == 2, F.concat(line, tag(n))).otherwise(line))
    block = F.concat(F.when(i % 8 == 4, "\nSources").otherwise(""), F.lit("\n## Sources\n- [doc-"), (i % 40).cast("string"), F.lit(" v1 #0]: doc-"), (i % 40).cast("string"), F.lit(" - chunk #0 - similarity=0.8125\n"))
    body = F.concat(F.array_join(lines, "\n"), F.when(i % 4 == 0, block).otherwise(""))
    return d.join(labels, "doc_id", "left").select(
        i.alias("draft_id"), body.alias("body"), (i % 50).alias("user_id"), F.timestamp_seconds(F.lit(1704067200) + i * 37 % 100000).alias("generated_at"), "quality", "toxic"
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of labelled documents; what they find are lines of the document, dealt to the kinds of findings by their place."""
    i = F.col("doc_id")
    verdict = F.when(i % 10 == 9, "fixable").when(F.col("quality") == 0, "unverifiable").when(F.col("toxic") == 0, "ok").otherwise("fixable")
    lines = F.split("text", "\n")
    found = lambda k: F.filter(lines, lambda line, n: (((n + 1) * 7 + i) % 23 == k) & (line != ""))
    labels = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return labels.select(
        i.alias("draft_id"),
        verdict.alias("verdict"),
        F.when(i % 10 == 9, F.concat(F.lit("corrected "), "text")).alias("corrected"),
        F.when(i % 20 == 9, "ok").when(i % 10 == 9, "fixable").alias("re_verdict"),
        *[found(k).alias(f) for k, f in enumerate(FINDINGS)],
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    i = F.col("conv_id")
    return c.select(i.alias("session_id"), (i % 17).alias("user_id"), i.alias("opened"), (i % 2 == 0).alias("is_closed"))


def storage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    i = F.col("document_id")
    record = F.struct(
        F.concat(F.lit("object-"), F.col("file_id").cast("string")).alias("id"),
        F.when(i % 23 == 0, "unknown").otherwise(F.col("storage_bucket")).alias("bucket_id"),
        F.when(i % 29 == 0, F.concat(i.cast("string"), F.lit("/x/"), F.col("original_filename"))).otherwise(F.col("storage_path")).alias("name"),
        F.when(i % 6 != 0, F.struct(F.col("size_bytes").alias("size"), F.lit("text/plain").alias("mimetype"))).alias("metadata"),
    )
    once = f.select(F.when(i % 9 == 0, "UPDATE").otherwise("INSERT").alias("type"), F.lit("objects").alias("table"), record.alias("record"), F.when(i % 5 == 0, 2).otherwise(1).alias("times"))
    return once.withColumn("n", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "n")


_FOLDER = "['templates', 'regulations', 'internal-policies', 'examples', 'misc'][(doc_id % 5 + 1)::INT]"
_CATEGORY = "['templates', 'national_regulations', 'internal_policies', 'examples', 'other'][(doc_id % 5 + 1)::INT]"
_BUCKET = "CASE category WHEN 'templates' THEN 'templates' WHEN 'national_regulations' THEN 'regulations' WHEN 'internal_policies' THEN 'policies' ELSE 'examples' END"
_STAMP = "TIMESTAMP '2024-01-01 00:00:00' + to_seconds(({} * 37 % 100000)::BIGINT)"

#: The same views for DuckDB; queries name those they need, and what those build on comes with them.
SQL = {
    "v_documents": f"""SELECT doc_id AS document_id, {_FOLDER} AS folder, 'local://' || {_FOLDER} || '/' || source || '/' || doc_id || '.txt' AS source_uri, {_CATEGORY} AS category,
      'doc-' || doc_id AS title, text AS content, n_chars, (1 + doc_id % 3)::INT AS current_version, doc_id % 11 <> 0 AS is_active,
      CASE doc_id % 13 WHEN 0 THEN 'failed' WHEN 1 THEN 'needs_ocr' WHEN 2 THEN 'needs_doc_conversion' WHEN 3 THEN 'pending' ELSE 'indexed' END AS status,
      CASE doc_id % 13 WHEN 0 THEN 'could not read: failed' WHEN 1 THEN 'could not read: needs_ocr' WHEN 2 THEN 'could not read: needs_doc_conversion' END AS error_message,
      {_STAMP.format("doc_id")} AS updated_at FROM documents""",
    "v_parts": r"SELECT document_id % 50 AS document_id, string_agg(replace(content, chr(10), chr(10) || chr(10)) || chr(10), chr(10) ORDER BY document_id) AS content FROM v_documents GROUP BY document_id % 50",
    "v_chunks": """SELECT vec_id AS chunk_id, vec_id // 5 AS document_id, CASE WHEN vec_id % 89 <> 0 THEN (1 + vec_id % 3)::INT END AS version, ((vec_id % 5) // 3)::INT AS chunk_index,
      (vec_id // 5) * 10 + 1 + vec_id % 3 AS file_id, CASE WHEN vec_id % 97 = 0 THEN list_transform(embedding, lambda x: (x * 0)::FLOAT) ELSE embedding END AS embedding, substring(text, (vec_id % 5) * ((length(text) + 4) // 5) + 1, (length(text) + 4) // 5) AS content
      FROM embeddings JOIN documents ON doc_id = vec_id // 5""",
    "v_files": f"""SELECT document_id * 10 + version AS file_id, document_id, version, {_BUCKET} AS storage_bucket,
      CASE WHEN document_id % 17 = 0 THEN 'C:\\legacy\\' || document_id || '.txt' ELSE document_id || '/v' || version || '/' || document_id || '.txt' END AS storage_path,
      document_id || '.txt' AS original_filename, sha256(content) AS sha256, n_chars AS size_bytes, CASE WHEN version > current_version THEN 'pending' ELSE status END AS status, updated_at,
      (coalesce(n, 0) + CASE WHEN document_id % 19 = 0 THEN 1 ELSE 0 END)::INT AS chunk_count
      FROM (SELECT *, unnest(range(1, current_version + 1 + CASE WHEN document_id % 7 = 0 THEN 1 ELSE 0 END))::INT AS version FROM v_documents)
      LEFT JOIN (SELECT file_id AS f, count(*) AS n FROM v_chunks GROUP BY 1) ON f = document_id * 10 + version""",
    "v_requests": "SELECT conv_id * 1000 + turn AS request_id, text FROM conversations WHERE role = 'user'",
    "v_queries": "SELECT vec_id AS request_id, embedding FROM embeddings WHERE vec_id % 100 = 0 UNION ALL SELECT -vec_id - 1, list_transform(embedding, lambda x: (x * 0)::FLOAT) FROM embeddings WHERE vec_id % 500 = 0",
    "v_spec": "SELECT * FROM (VALUES ('templates', 5, 0.20::DOUBLE, 3), ('internal_policies', 8, 0.25::DOUBLE, 6), ('national_regulations', 8, 0.25::DOUBLE, 6)) t(category, k, threshold, cap)",
    "v_jobs": """SELECT event_id AS job_id, user_id * 10 + 1 AS file_id, CASE WHEN event_type IN ('signup', 'purchase') THEN 'pending' WHEN event_type = 'view' THEN 'processing' WHEN event_type = 'click' THEN 'done' ELSE 'failed' END AS status,
      (50 + 50 * (event_id % 4))::INT AS priority, ts AS scheduled_at, CASE WHEN event_id % 3 <> 0 THEN ts END AS claimed_at, (event_id % 6)::INT AS attempts, 5 AS max_attempts FROM events""",
    "v_catalogue": """SELECT * FROM (VALUES ('notice', 1, 'Notice', ['the', 'and', 'of']), ('request', 2, 'Request', ['to', 'of', 'in']), ('reply', 3, 'Reply', ['la', 'le', 'de']), ('report', 4, 'Report', ['und', 'der', 'to'])) t(type, ord, label, keywords)""",
    "v_drafts": f"""SELECT d.doc_id AS draft_id, array_to_string(list_transform(range(1, len(l) + 1), lambda n: l[n] || CASE WHEN (n - 1) % 3 = 2 THEN ' [source: doc-' || ((d.doc_id + n - 1) % 40) || ' v1 #' || ((n - 1) % 3) || ']' ELSE '' END), chr(10))
      || CASE WHEN d.doc_id % 4 = 0 THEN CASE WHEN d.doc_id % 8 = 4 THEN chr(10) || 'Sources' ELSE '' END || chr(10) || '## Sources' || chr(10) || '- [doc-' || (d.doc_id % 40) || ' v1 #0]: doc-' || (d.doc_id % 40) || ' - chunk #0 - similarity=0.8125' || chr(10) ELSE '' END AS body,
      d.doc_id % 50 AS user_id, {_STAMP.format("d.doc_id")} AS generated_at, quality, toxic FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents) d LEFT JOIN labels USING (doc_id)""",
    "v_reviews": """SELECT doc_id AS draft_id, CASE WHEN doc_id % 10 = 9 THEN 'fixable' WHEN quality = 0 THEN 'unverifiable' WHEN toxic = 0 THEN 'ok' ELSE 'fixable' END AS verdict,
      CASE WHEN doc_id % 10 = 9 THEN 'corrected ' || text END AS corrected, CASE WHEN doc_id % 20 = 9 THEN 'ok' WHEN doc_id % 10 = 9 THEN 'fixable' END AS re_verdict, """
    + ", ".join(f"list_filter(l, lambda x, n: (n * 7 + doc_id) % 23 = {k} AND x <> '') AS {f}" for k, f in enumerate(FINDINGS))
    + " FROM (SELECT labels.*, text, string_split(text, chr(10)) AS l FROM labels JOIN documents USING (doc_id))",
    "v_sessions": "SELECT DISTINCT conv_id AS session_id, conv_id % 17 AS user_id, conv_id AS opened, conv_id % 2 = 0 AS is_closed FROM conversations",
    "v_events": """SELECT CASE WHEN document_id % 9 = 0 THEN 'UPDATE' ELSE 'INSERT' END AS type, 'objects' AS "table", CASE WHEN document_id % 23 = 0 THEN 'unknown' ELSE storage_bucket END AS bucket_id,
      CASE WHEN document_id % 29 = 0 THEN document_id || '/x/' || original_filename ELSE storage_path END AS name, CASE WHEN document_id % 6 <> 0 THEN size_bytes END AS size_bytes, original_filename, unnest(range(0, CASE WHEN document_id % 5 = 0 THEN 2 ELSE 1 END)) AS n FROM v_files""",
}


def oracle(body: str) -> str:
    """body with the views that it names, and theirs, as common table expressions."""
    need: list[str] = []

    def add(text: str) -> None:
        for name, sql in SQL.items():
            if name in text and name not in need:
                add(sql)
                need.append(name)

    add(body)
    views = ", ".join(f"{n} AS ({SQL[n]})" for n in need)
    if not need:
        return body
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(start):
            return f"{start}{views}, {body[len(start):]}"
    return f"WITH {views} {body}"
