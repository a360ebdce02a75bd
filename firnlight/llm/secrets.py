"""Secret scans over every historical version of a text, by an incremental ledger.

Each version is addressed by the SHA-256 of its content. A ledger table holds,
for each blob, which rule versions have read it and what they found; a scan
reads only the (blob, rule version) pairs that the ledger lacks, appends them,
and joins the findings back to all paths with that content. Copies are thus
scanned once, a new commit costs only its new blobs, and a changed rule only
its own pass.

Everything is DataFrame and SQL functions. Positions come from splitting a text
at a rule's matches: a match starts after all pieces and matches before it. The
running sum goes by chunks of matches, so the work is linear in their number.

Edge cases: null text counts as empty; a blob without findings has an empty
list; equal texts share a blob; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, read, shared_dir, splittable_join


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has ``least`` characters.

    ``hint``: a literal that every match holds, to pass over texts cheaply.
    """

    kind: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 1
    hint: str = ""

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6),
    Rule("access", "AKIA[A-Z0-9]{16,}", hint="AKIA"),
    Rule("hex", "[0-9a-f]{24,}"),
)
KEY_HEADER = Rule("private_key", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", hint="PRIVATE KEY-----")
#: From the header to the END line; without one, to the end of the base64 lines (breaks may be written out as \n).
#: Possessive loops, as they do not recurse: a block may have any number of lines.
KEY_BLOCK = Rule(
    "private_key",
    KEY_HEADER.pattern + r"(?:(?:(?!-----)[\s\S])*+-----END [A-Z ]{0,40}PRIVATE KEY-----"
    r"|(?:(?:\s|\\+[nr])*+(?:Proc-Type|DEK-Info):[^\n\\]*+)*+(?:(?:\s|\\+[nr])*+[A-Za-z0-9+/=]{20,}+)*+(?:(?:\s|\\+[nr])++[A-Za-z0-9+/=]++(?=\s*+(?:\n|\z)|\\|[\"']))?+)",
    version=2, hint="PRIVATE KEY-----")
RULES = (
    *BASE_RULES,
    KEY_BLOCK,
    Rule("vcs_token", "gh[pousr]_[A-Za-z0-9]{36,}", hint="gh"),
)

#: Matches of a text that one fold gathers, as each step of it copies what it has so far.
CHUNK = 256

FINDING = "array<struct<start:long,rank:int,end:long,kind:string>>"


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("string"), 256)


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """Findings of one rule: code points, end exclusive, leftmost without overlaps."""
    pattern = F.lit(rule.pattern)
    parts = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("before"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("value"),
    )

    def width(x: Column) -> Column:
        return (F.length(x["before"]) + F.coalesce(F.length(x["whole"]), F.lit(0))).cast("long")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["before"])
        end = acc["at"] + width(x)
        found = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))).cast(FINDING)
        kept = F.when(F.coalesce(F.length(x["value"]), F.lit(0)) >= rule.least, F.concat(acc["found"], found)).otherwise(acc["found"])
        return F.struct(end.alias("at"), kept.alias("found"))

    none = F.array().cast(FINDING)
    zero = F.lit(0).cast("long")

    def gathered(p: Column) -> Column:
        last = F.floor((F.size(p) - 1) / CHUNK).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(p, i * CHUNK + 1, F.lit(CHUNK)))
        starts = F.aggregate(
            chunks, F.array(zero), lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + F.aggregate(c, zero, lambda n, x: n + width(x)))))
        folded = F.zip_with(
            chunks, starts, lambda c, at: F.coalesce(F.aggregate(c, F.struct(at.alias("at"), none.alias("found")), step, lambda acc: acc["found"]), none))
        return F.flatten(folded)

    hit = text.rlike(rule.pattern)
    if rule.hint:
        hit = F.contains(text, F.lit(rule.hint)) & hit
    # Within the transform the pieces are a variable, made once and not in every chunk.
    return F.when(hit, F.element_at(F.transform(F.array(parts), gathered), 1)).otherwise(none)


def scan(blobs: DataFrame, rules=RULES, blob: str = "blob_id", text: str = "text", todo: str = "todo") -> DataFrame:
    """Ledger rows (blob_id, rule_versions, findings) of each blob's ``todo`` rules."""
    none = F.array().cast(FINDING)
    found = [F.when(F.array_contains(todo, r.id), spans(F.col(text), r, i)).otherwise(none) for i, r in enumerate(rules)]
    return blobs.select(F.col(blob).alias("blob_id"), F.col(todo).alias("rule_versions"), F.sort_array(F.concat(*found)).alias("findings"))


def unseen(versions: DataFrame, ledger: DataFrame | None, rules=RULES, text: str = "text") -> DataFrame:
    """One row per blob with unread rules: (blob_id, text, todo).

    Copies meet in a partial aggregation before the shuffle, so a blob that
    holds a third of all rows arrives as one row from each task.
    """
    ids = F.array(*[F.lit(r.id) for r in rules])
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    blobs = versions.select(value.alias("text")).groupBy(blob_id(F.col("text")).alias("blob_id")).agg(F.first("text").alias("text"))
    if ledger is None:
        return blobs.withColumn("todo", ids)
    seen = ledger.groupBy("blob_id").agg(F.array_distinct(F.flatten(F.collect_set("rule_versions"))).alias("seen"))
    out = blobs.join(seen, "blob_id", "left").withColumn("todo", F.array_except(ids, F.coalesce("seen", F.array().cast("array<string>"))))
    return out.where(F.size("todo") > 0).drop("seen")


def open_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger at ``path``; None if nothing has been written there."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema(f"blob_id string, rule_versions array<string>, findings {FINDING}").parquet(path)


def update_ledger(versions: DataFrame, path: str, rules=RULES, text: str = "text") -> DataFrame:
    """Scan what the ledger at ``path`` lacks, append it, and return the ledger."""
    spark = versions.sparkSession
    scan(unseen(versions, open_ledger(spark, path), rules, text), rules).write.mode("append").parquet(path)
    return open_ledger(spark, path)


def findings(versions: DataFrame, ledger: DataFrame, rules=RULES, text: str = "text", blob: str = "blob_id", out: str = "findings") -> DataFrame:
    """All rows of ``versions`` with their blob and its findings under ``rules``.

    Only blobs with findings are joined, each once; the versions' side of a hot
    blob may be split by adaptive execution, as the other side is one row.
    """
    ids = [r.id for r in rules]
    versions_of = F.map_from_arrays(F.array(*[F.lit(r.kind) for r in rules]), F.array(*[F.lit(i) for i in ids]))
    key, got = fresh(versions, "blob__", "findings__")
    hits = (
        ledger.where(F.size("findings") > 0)
        .select("blob_id", F.filter("findings", lambda f: F.array_contains("rule_versions", versions_of[f["kind"]])).alias("findings"))
        .where(F.size("findings") > 0)
        .groupBy(F.col("blob_id").alias(key))
        .agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("findings")))).alias(got))
    )
    joined = splittable_join(versions.withColumn(key, blob_id(F.col(f"`{text}`"))), hits, key, "left")
    extra = {blob: F.col(key), out: F.coalesce(F.col(got), F.array().cast(FINDING))}
    return joined.select(*[F.col(f"`{c}`") for c in versions.columns if c not in extra], *[e.alias(c) for c, e in extra.items()])


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def redacted(text: Column, found: Column) -> Column:
    """The text with each finding replaced by its kind in brackets; overlaps count once.

    The text is cut where chunks of findings end, and each piece is masked by itself.
    """

    def masked(x: Column) -> Column:
        def step(acc: Column, f: Column) -> Column:
            start, end = f["start"] - x["base"], f["end"] - x["base"]
            between = x["piece"].substr((acc["at"] + 1).cast("int"), F.greatest(start - acc["at"], F.lit(0)).cast("int"))
            mask = F.when(start >= acc["at"], F.concat(between, F.lit("["), f["kind"], F.lit("]"))).otherwise(F.lit(""))
            return F.struct(F.greatest(end, acc["at"]).alias("at"), F.concat(acc["out"], mask).alias("out"))

        return F.aggregate(x["chunk"], F.struct(zero.alias("at"), F.lit("").alias("out")), step, lambda acc: acc["out"])

    def joined(all_: Column) -> Column:
        def piece(c: Column, i: Column) -> Column:
            base = F.get(all_["bases"], i)
            span = text.substr((base + 1).cast("int"), (F.get(all_["bases"], i + 1) - base).cast("int"))
            return F.struct(c.alias("chunk"), base.alias("base"), span.alias("piece"))

        tail = text.substr((F.element_at(all_["bases"], -1) + 1).cast("int"), F.length(text))
        return F.concat(F.array_join(F.transform(F.transform(all_["chunks"], piece), masked), ""), tail)

    zero = F.lit(0).cast("long")
    last = F.floor((F.size(found) - 1) / CHUNK).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(found, i * CHUNK + 1, F.lit(CHUNK)))
    bases = F.aggregate(
        chunks, F.array(zero), lambda acc, c: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), F.array_max(F.transform(c, lambda f: f["end"]))))))
    # As a variable of the transform, chunks and cuts are made once.
    done = F.element_at(F.transform(F.array(F.struct(chunks.alias("chunks"), bases.alias("bases"))), joined), 1)
    return F.when(F.size(found) > 0, done).otherwise(text)


def redact_secrets(docs: DataFrame, ledger_path: str, rules=RULES) -> DataFrame:
    """The documents with every found secret masked; no document goes.

    ``n_chars``, where present, is the new length. Null texts stay null.
    """
    ledger = update_ledger(docs, ledger_path, rules)
    got, key = fresh(docs, "found__", "blob__x")
    new = redacted(F.col("text"), F.col(got))
    out = findings(docs, ledger, rules, blob=key, out=got).withColumn("text", new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(got) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = update_ledger(docs, f"{shared_dir(spark)}/secret-ledger-{uuid.uuid4().hex}")
    out = findings(docs, ledger)
    base = F.filter("findings", lambda f: f["rank"] < len(BASE_RULES))

    def count(i: int):
        return F.size(F.filter("findings", lambda f: f["rank"] == i)).cast("long")

    return out.select("doc_id", *[count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE_RULES)], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("findings")).alias("spans"), "blob_id")


#: KEY_BLOCK for engines without lookahead: what stands for the key is in groups 1 to 3, what must follow it in none.
_SEP, _HEAD = r"(?:[ \t\n\x0B\f\r]|\\+[nr])", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
SQL_KEY_BLOCK = (
    rf"(?:({_HEAD}(?:-{{0,4}}[^-])*-----END [A-Z ]{{0,40}}PRIVATE KEY-----)|({_HEAD}(?:{_SEP}*(?:Proc-Type|DEK-Info):[^\n\\]*)*(?:{_SEP}*[A-Za-z0-9+/=]{{20,}})*)"
    rf"(?:({_SEP}+[A-Za-z0-9+/=]+)(?:[ \t\n\x0B\f\r]*(?:\n|\z)|\\|[\"']))?)")


def _duck(rank: int, rule: Rule) -> str:
    key = rule is KEY_BLOCK
    p = (SQL_KEY_BLOCK if key else rule.pattern).replace("'", "''")
    parts = [f"coalesce(regexp_extract_all(text, '{p}', {g})[i], '')" for g in (1, 2, 3)]
    span = " || ".join(parts) if key else "whole[i]"
    value = "whole" if key else f"regexp_extract_all(text, '{p}', {rule.group})"
    return f"""
  SELECT blob_id, {rank} AS rank, '{rule.kind}' AS kind, i, before, whole, value, {span} AS span, {rule.least} AS least
  FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM (SELECT blob_id, text, string_split_regex(text, '{p}') AS before, whole, {value} AS value
        FROM (SELECT *, regexp_extract_all(text, '{p}', 0) AS whole FROM blobs)))"""


ORACLE = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, sha256(coalesce(text, '')) AS blob_id FROM documents),
blobs AS (SELECT blob_id, any_value(text) AS text FROM docs GROUP BY blob_id),
hits AS ({" UNION ALL ".join(_duck(i, r) for i, r in enumerate(RULES))}),
spans AS (
  SELECT blob_id, rank, kind, start, start + length(span) AS stop FROM (
    SELECT *, coalesce(list_sum(list_transform(before[1:i], lambda s: length(s))), 0)::BIGINT
            + coalesce(list_sum(list_transform(whole[1:i - 1], lambda s: length(s))), 0)::BIGINT AS start FROM hits)
  WHERE length(value[i]) >= least),
found AS (
  SELECT blob_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < {len(BASE_RULES)}), '') AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
  FROM spans GROUP BY blob_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
       coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, docs.blob_id
FROM docs LEFT JOIN found USING (blob_id)
"""
