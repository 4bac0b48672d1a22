"""Secret scans over an incremental ledger of content-addressed blobs, with DataFrame functions only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, shared_dir, stash, table

# fixed values: the patterns of the base rules (letters of the keywords in either case)
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?"""
VALUE = r"[A-Za-z0-9+/_.=-]+"
# kind, pattern, least length, pattern that cuts off what doesn't count towards it, and strings of which a text has one (in lower case)
BASE_RULES = [
    ("assign", ASSIGN + VALUE, 6, "^" + ASSIGN, ("passw", "secret", "token", "api")),
    ("access", r"AKIA[A-Z0-9]+", 20, None, ("akia",)),
    ("hex", r"[0-9a-f]+", 24, None, ()),
]
MORE_RULES = [
    # up to the END line; where that is missing, the lines of base64 that follow
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*(?:-[^-]+){0,20}-----END [A-Z ]*PRIVATE KEY-----|(?:[\x20\x09\x0A\x0D]+[A-Za-z0-9+/=]{16,})*)", 0, None, ("private key-----",)),
    ("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, None, ("eyj",)),
]
RULES = BASE_RULES + MORE_RULES
RULES_VERSION = "2"
#: after: where the spans that begin before this one have ended (0 for the first).
SPAN = "array<struct<start:int,rank:int,kind:string,end:int,after:int>>"
#: Rows that may be broadcast: digests of known blobs, findings, and spans of findings.
BROADCAST_BLOBS, BROADCAST_FINDINGS, BROADCAST_SPANS = 200_000, 100_000, 1_000_000


def _pattern(rule: tuple) -> str:
    """The rule's pattern; runs of hex digits that are too short are left out, as a run is matched whole or not at all."""
    return rule[1][:-1] + "{%d,}" % rule[2] if rule[0] == "hex" else rule[1]


def _hit(text: Column, rule: tuple) -> Column:
    """Whether the rule's pattern occurs; a hint that is missing answers without a search."""
    hinted = F.lit(not rule[4])
    for hint in rule[4]:
        hinted = hinted | F.contains(F.lower(text), F.lit(hint))
    return hinted & F.regexp_like(text, F.lit(_pattern(rule)))


def suspicious(text: Column, rules=RULES) -> Column:
    found = F.lit(False)
    for rule in rules:
        found = found | _hit(text, rule)
    return F.coalesce(found, F.lit(False))


def _matches(text: Column, rank: int, rule: tuple) -> Column:
    """A rule's matches in order: their place among them, the length of what lies before each, their own, and whether they count."""
    kind, _, least, cut, _ = rule
    found = F.regexp_extract_all(text, F.lit(_pattern(rule)), F.lit(0))
    gaps = F.transform(F.split(text, _pattern(rule), -1), lambda x: F.length(x))
    counted = lambda m: F.length(F.regexp_replace(m, cut, "") if cut else m)
    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda gap, m: F.struct(gap.alias("gap"), F.length(m).alias("n"), (counted(m) >= least).alias("fits")))
    rows = F.transform(pairs, lambda x, i: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["n"].alias("n"), x["fits"].alias("fits")))
    return F.when(_hit(text, rule), rows).otherwise(F.array().cast("array<struct<rank:int,kind:string,i:int,gap:int,n:int,fits:boolean>>"))


#: Names the place of the ledger of op8_secret_scan.
LEDGER_SETTING = "fundlattice.secrets.ledger"
LEDGER = f"blob string, rules_version string, spans {SPAN}"


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", rules=RULES, rules_version: str = RULES_VERSION) -> DataFrame:
    """Ledger rows of the blobs in versions that the ledger lacks for this version of the rules.

    A blob is a distinct text, known by its SHA-256. Known blobs are left out before any pattern is tried, where
    their digests are few enough to be broadcast, and by a join of digests otherwise. Rows move with their digests; a
    text goes along only where a rule's pattern occurs, and its matches are taken once, however many rows hold it.
    Pieces between matches and matches make up the text, so running sums of their lengths give the places.

    Returns blob, rules_version, spans (sorted by start, then in the rules' order, in code points, the end
    exclusive; empty without findings). Append them to the ledger that the next run gets.
    """
    rows = versions.select(blob_id(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    seen = None if ledger is None else ledger.where(F.col("rules_version") == rules_version).select("blob").distinct()
    few = seen is not None and seen.limit(BROADCAST_BLOBS + 1).count() <= BROADCAST_BLOBS
    if few:
        rows = rows.join(F.broadcast(seen), "blob", "left_anti")
    rows = rows.select("blob", F.when(suspicious(F.col("text"), rules), F.col("text")).alias("text"))
    if seen is not None and not few:
        rows = rows.join(seen, "blob", "left_anti")
    blobs = rows.groupBy("blob").agg(F.first("text").alias("text"))
    hits = blobs.select("blob", F.explode_outer(F.concat(*[_matches(F.col("text"), i, rule) for i, rule in enumerate(rules)])).alias("h")).select("blob", "h.*")
    ends = hits.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(Window.partitionBy("blob", "rank").orderBy("i")).cast("int")).withColumn("start", F.col("end") - F.col("n"))
    spans = ends.withColumn("fits", F.coalesce("fits", F.lit(False)))
    earlier = Window.partitionBy("blob").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("after", F.coalesce(F.max(F.when(F.col("fits"), F.col("end"))).over(earlier), F.lit(0)))
    every = F.array_sort(F.collect_list(F.when(F.col("fits"), F.struct("start", "rank", "kind", "end", "after"))))
    return spans.groupBy("blob").agg(every.alias("spans")).select("blob", F.lit(rules_version).alias("rules_version"), "spans")


def update_ledger(versions: DataFrame, path: str, text_col: str = "text", rules=RULES, rules_version: str = RULES_VERSION) -> DataFrame:
    """The ledger stored at path, after the blobs of versions that it lacks have been scanned and appended.

    It lies by rules_version, so other versions' rows aren't read. A run that dies before its append is committed leaves the
    ledger as it was; the next run scans what is missing.
    """
    spark = versions.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    old = spark.read.schema(LEDGER).parquet(path) if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where) else None
    scan_unseen(versions, old, text_col, rules, rules_version).write.mode("append").partitionBy("rules_version").parquet(path)
    return spark.read.schema(LEDGER).parquet(path).select("blob", "rules_version", "spans")


def compact_ledger(spark: SparkSession, path: str, to: str) -> DataFrame:
    """The ledger at path written to another place with each blob once for a version of the rules and few files; the old one stays."""
    spark.read.schema(LEDGER).parquet(path).dropDuplicates(["blob", "rules_version"]).write.partitionBy("rules_version").parquet(to)
    return spark.read.schema(LEDGER).parquet(to).select("blob", "rules_version", "spans")


def find_secrets(versions: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", rules=RULES, rules_version: str = RULES_VERSION) -> DataFrame:
    """Findings of every row of versions: id_col, blob, spans.

    The ledger's findings are joined back to all rows by content address; what the ledger lacks is scanned first.
    A ledger that update_ledger() has returned for versions lacks nothing: say so with join_findings(). One row
    for each row of versions; a null text is empty and has no findings; rows with a null id are kept.
    """
    known = scan_unseen(versions, ledger, text_col, rules, rules_version)
    if ledger is not None:
        known = known.unionByName(ledger.select("blob", "rules_version", "spans"))
    return join_findings(versions, known, id_col, text_col, rules_version)


def join_findings(versions: DataFrame, ledger: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules_version: str = RULES_VERSION) -> DataFrame:
    """The ledger's findings for every row of versions: id_col, blob, spans.

    Findings are stored first, one for each blob that has some. Up to BROADCAST_FINDINGS of them are broadcast; more are
    joined by content address in a shuffle of digests, which AQE may split. A blob that the ledger holds twice counts once.
    """
    found = ledger.where((F.col("rules_version") == rules_version) & (F.size("spans") > 0)).select("blob", "spans").dropDuplicates(["blob"])
    hits = stash(found, "findings")
    rows = versions.select(F.col(id_col), blob_id(F.col(text_col)).alias("blob"))
    out = rows.join(F.broadcast(hits) if _few(hits) else hits, "blob", "left")
    return out.select(id_col, "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def _few(hits: DataFrame, spans: str = "spans") -> bool:
    size = hits.agg(F.count("*").alias("n"), F.sum(F.size(spans)).alias("spans")).first()
    return size["n"] <= BROADCAST_FINDINGS and (size["spans"] or 0) <= BROADCAST_SPANS


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by ``[REDACTED]``."""
    piece = lambda s: F.when(s["start"] >= s["after"], F.concat(F.substring(text, s["after"] + 1, s["start"] - s["after"]), F.lit("[REDACTED]"))).otherwise(F.lit(""))
    end = F.array_max(F.transform(spans, lambda s: s["end"]))
    done = F.concat(F.array_join(F.transform(spans, piece), ""), F.substring(text, end + 1, F.length(text)))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redact_secrets(docs: DataFrame, text_col: str = "text", n_chars_col: str | None = "n_chars") -> DataFrame:
    """docs with every secret in text_col replaced, and n_chars_col (if there) the new length of those texts.

    All rows and columns stay; a text without findings, null included, is as it was. Findings are broadcast where they
    are few; else the rows in which some rule's pattern occurs, and no others, are shuffled to their blob's findings.
    """
    blob, spans = free_name(docs.columns, "_blob"), free_name(docs.columns, "_spans")
    found = scan_unseen(docs, text_col=text_col).where(F.size("spans") > 0)
    hits = stash(found.select(F.col("blob").alias(blob), F.col("spans").alias(spans)), "findings")

    def replaced(rows: DataFrame, hits: DataFrame) -> DataFrame:
        rows = rows.withColumn(blob, blob_id(F.col(text_col))).join(hits, blob, "left")
        some = F.col(spans).isNotNull()
        rows = rows.withColumn(text_col, F.when(some, redact(F.col(text_col), F.col(spans))).otherwise(F.col(text_col)))
        if n_chars_col in docs.columns:
            kind = docs.schema[n_chars_col].dataType
            rows = rows.withColumn(n_chars_col, F.when(some, F.length(text_col).cast(kind)).otherwise(F.col(n_chars_col)))
        return rows.select(*docs.columns)

    if _few(hits, spans):
        return replaced(docs, F.broadcast(hits))
    clean = ~suspicious(F.col(text_col))
    return docs.where(clean).unionAll(replaced(docs.where(~clean), hits))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are scanned into a ledger, and its findings joined back to all of them.

    LEDGER_SETTING names the ledger's place; runs that share it scan only texts that none of them has seen. Where it is unset each
    run begins a ledger of its own, and scans all.
    """
    docs = table(spark, sf_dir, "documents")
    place = spark.conf.get(LEDGER_SETTING, None) or f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    found = join_findings(docs, update_ledger(docs, place))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_RULES))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _kind_sql(name: str, rank: int, rule: tuple) -> str:
    kind, pattern, least, cut, _ = rule
    quoted = pattern.replace("'", "''")
    kept = f"length(regexp_replace(m, '{cut.replace(chr(39), chr(39) * 2)}', ''))" if cut else "length(m)"
    return f"""
{name} AS (
  SELECT doc_id, {rank} AS rank, '{kind}' AS kind, list_sum(g[:i]) + coalesce(list_sum(n[:i-1]), 0) AS b, length(m) AS len FROM (
    SELECT doc_id, list_transform(string_split_regex(text, '{quoted}'), lambda x: length(x)) AS g,
           list_transform(ms, lambda x: length(x)) AS n, unnest(ms) AS m, generate_subscripts(ms, 1) AS i
    FROM (SELECT doc_id, text, regexp_extract_all(text, '{quoted}') AS ms FROM t WHERE regexp_matches(text, '{quoted}')))
  WHERE {kept} >= {least})"""


OP8_SQL = (
    "WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),"
    + ",".join(_kind_sql(f"k{i}", i, rule) for i, rule in enumerate(RULES))
    + ", s AS ("
    + " UNION ALL ".join(f"SELECT * FROM k{i}" for i in range(len(RULES)))
    + r"""), a AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || b::BIGINT || ':' || (b + len)::BIGINT, ',' ORDER BY b, rank) AS spans,
         string_agg(kind || ':' || b::BIGINT || ':' || (b + len)::BIGINT, ',' ORDER BY b, rank) FILTER (rank < 3) AS base
  FROM s GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN a ON t.doc_id = a.doc_id"""
)
