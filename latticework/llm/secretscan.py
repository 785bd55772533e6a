"""Secret scans over an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content, and the
ledger keeps the text of every blob, so that history can be scanned again.  It
says which (blob, rule version) pairs were scanned; a scan takes only the pairs
that it lacks, of the versions that come in and of all that came before,
records them and their findings, and joins all findings of the given rules back
to every path that ever held the blob.

Texts are looked at for pairs that are open alone.  Whether a rule's literal
anchor occurs settles most of them; only blobs with an anchor travel on, so the
shuffle carries addresses and few texts.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import BROADCAST_BYTES
from .common import apart, maybe_broadcast, shared_dir


@dataclass(frozen=True)
class Rule:
    """A secret's pattern; `anchors` are lower-case literals of which every match holds one."""

    name: str
    version: int
    pattern: str
    anchors: tuple[str, ...]

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


#: A key from its BEGIN line through its END line, with header fields (Proc-Type) and lines behind a quote, a comment sign or a diff's
#: minus; where the END line is missing, to the end of the base64 body.  Java, RE2 and Python read it alike.
_PRIVATE_KEY = (
    r"-----BEGIN (?:[0-9A-Z]+ )*PRIVATE KEY(?: BLOCK)?-----"
    r"(?:[ \t\r]*(?:\n|\\r\\n|\\n)[ \t+#>-]*[A-Z][0-9A-Za-z-]{1,30}: ?[^\n\\]*)*"
    r"(?:[^-]*(?:\n-{1,3}[^-]+)*-{5,}END (?:[0-9A-Z]+ )*PRIVATE KEY(?: BLOCK)?-----"
    r"|(?:(?:[\s\\\"'>#,]*[0-9A-Za-z+/=]{16,})+(?:(?:\r?\n|\\n)[0-9A-Za-z+/=]{1,15})?)?)"
)
#: Between a name and its value; the name may end with a quote, as in JSON, itself escaped or not.
_ASSIGNED = r"\\?[\"']? ?[=:] ?\\?[\"']?"

RULES = (
    Rule("aws_access_key", 1, r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", ("akia", "asia")),
    Rule("github_token", 1, r"\bgh[pousr]_[0-9A-Za-z]{36}\b", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack_token", 1, r"\bxox[abprs]-[0-9A-Za-z-]{10,}", ("xox",)),
    Rule("google_api_key", 1, r"\bAIza[0-9A-Za-z_-]{35}", ("aiza",)),
    Rule("stripe_key", 1, r"\b[sr]k_live_[0-9A-Za-z]{16,}", ("k_live_",)),
    Rule("private_key", 2, _PRIVATE_KEY, ("-----begin",)),
    Rule("json_web_token", 1, r"\beyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}", ("eyj",)),
    Rule("password_assignment", 2, rf"(?i:\b[0-9a-z_]*(?:password|passwd|pwd)){_ASSIGNED}[0-9A-Za-z_+/!@#$%^&*.-]{{8,}}", ("password", "passwd", "pwd")),
    Rule("token_assignment", 2, rf"(?i:\b[0-9a-z_]*(?:token|secret|api_key|apikey|access_key)){_ASSIGNED}[0-9A-Za-z_+/=-]{{16,}}", ("token", "secret", "api_key", "apikey", "access_key")),
    Rule("url_credentials", 1, r"\b[a-z][0-9a-z+.-]{1,15}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@", ("://",)),
)
#: Blobs with a few rule names each that are sent to every executor at most.
_MOST = BROADCAST_BYTES // 256
#: What a secret is replaced by.
MASK = "[SECRET]"


class Ledger:
    """Three Parquet tables under one folder that all executors share: versions, scanned pairs, findings.

    Every scan writes folders of its own, so scans may run side by side.  One
    that is cut off leaves pairs open, which the next scan takes; what it had
    found already is then found again, and counts once.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self, table: str, schema: str) -> DataFrame:
        try:
            found = self.spark.read.schema(schema).parquet(f"{self.path}/{table}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)
        return found.drop("run")

    def _append(self, df: DataFrame, table: str) -> None:
        df.write.option("compression", "zstd").parquet(f"{self.path}/{table}/run={uuid.uuid4().hex}")

    @property
    def stored(self) -> DataFrame:
        """(path, blob, text): text where a blob was new; equal texts that came together are each kept."""
        return self.read("versions", "path string, blob binary, text string")

    @property
    def versions(self) -> DataFrame:
        return self.stored.select("path", "blob")

    @property
    def scanned(self) -> DataFrame:
        """(blob, rules): the rule versions under which a blob was scanned; a blob has a row for each scan."""
        return self.read("scanned", "blob binary, rules array<string>")

    @property
    def findings(self) -> DataFrame:
        return self.read("findings", "blob binary, rule string, secret string, n_hits long").dropDuplicates(["blob", "rule", "secret"])

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> int:
        """Take in versions (path string, text string) and scan every open pair of the ledger; the number of pairs that were.

        Versions with a null text are left out; an empty text is a blob like
        any other.  Null paths and repeated versions are recorded as they come,
        a pair is scanned once however often the blob occurs.
        """
        text = F.col("text")
        addressed = versions.select(F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text")).where("text is not null")
        addressed = addressed.select("path", F.unhex(F.sha2(text, 256)).alias("blob"), "text")
        known = self.versions.select("blob").distinct()
        n = known.count()
        if 0 < n <= _MOST:
            old = F.broadcast(known.withColumn("old", F.lit(True)))
            addressed = addressed.join(old, "blob", "left").select("path", "blob", F.when(F.col("old").isNull(), text).alias("text"))
        elif n:
            # Texts are not shuffled to learn whether they are known; where too much is new as well, known ones are kept again.
            new = addressed.select("blob").distinct().join(known, "blob", "left_anti")
            if new.count() <= _MOST:
                addressed = addressed.join(F.broadcast(new.withColumn("new", F.lit(True))), "blob", "left").select("path", "blob", F.when(F.col("new"), text).alias("text"))
        self._append(addressed, "versions")
        if not rules:
            return 0
        keys = F.array(*[F.lit(r.key) for r in rules])
        blobs = self.versions.select("blob").distinct()
        if self.scanned.isEmpty():
            open_, work, later = blobs.withColumn("open", keys), self.stored.where("text is not null").withColumn("open", keys), False
        else:
            done = self.scanned.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("rules"))
            left = F.array_except(keys, F.coalesce("rules", F.array().cast("array<string>")))
            open_ = blobs.join(done, "blob", "left").select("blob", left.alias("open")).where(F.size("open") > 0)
            n_open, work = open_.count(), self.stored.where("text is not null")
            later = n_open > _MOST
            # Few open blobs choose their texts; of many, texts with an anchor are chosen first, so that no others are shuffled.
            work = work.withColumn("open", keys) if later else work.join(F.broadcast(open_), "blob")
        low = F.lower(text)
        held = F.transform(F.array(low), lambda t: F.array_compact(F.array(*[F.when(F.array_contains("open", r.key) & _any(t, r.anchors), F.lit(r.key)) for r in rules])))
        # One text per blob, of those that hold an anchor.
        work = work.select("blob", "text", F.get(held, F.lit(0)).alias("held")).where(F.size("held") > 0)
        work = work.groupBy("blob").agg(F.first("text").alias("text"), F.first("held").alias("held"))
        if later:
            work = work.join(open_, "blob").withColumn("held", F.array_intersect("held", "open"))
        work = work.select("blob", "text", F.explode("held").alias("rule"))
        matches = F.coalesce(*[F.when(F.col("rule") == r.key, F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))) for r in rules])
        hits = work.select("blob", "rule", F.explode(matches).alias("secret")).groupBy("blob", "rule", "secret").agg(F.count(F.lit(1)).alias("n_hits"))
        # Findings first: a pair counts as scanned only once its findings are stored.
        self._append(hits, "findings")
        folder = f"scanned/run={uuid.uuid4().hex}"
        open_.select("blob", F.col("open").alias("rules")).write.parquet(f"{self.path}/{folder}")
        return self.read(folder, "blob binary, rules array<string>").agg(F.coalesce(F.sum(F.size("rules")), F.lit(0))).first()[0]

    def by_path(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """(path, blob, rule, secret, n_hits) of the given rule versions, for every path and version that the ledger knows."""
        found = self.findings.where(F.col("rule").isin([r.key for r in rules]))
        n = found.count()
        return self.versions.join(maybe_broadcast(found, n, 512), "blob").select("path", "blob", "rule", "secret", "n_hits").distinct()


def _any(low, anchors):
    held = F.contains(low, F.lit(anchors[0]))
    for a in anchors[1:]:
        held = held | F.contains(low, F.lit(a))
    return held


def _ledger(docs: DataFrame, path: str | None) -> tuple[Ledger, DataFrame]:
    """The ledger at `path`, or a new one in the shared folder, and the documents as versions whose path is their id."""
    spark = docs.sparkSession
    versions = docs.select(docs["doc_id"].cast("string").alias("path"), docs["text"])
    return Ledger(spark, path or f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"), versions


def scan_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, path: str | None = None, increments: tuple[tuple[Rule, ...], ...] = ()) -> DataFrame:
    """Findings in every document: (doc_id, rule, secret_sha256, n_hits, blob).

    Documents are versions whose path is their id; `path` is the ledger's
    folder (by default a new one in the shared folder).  The secret itself
    isn't given, only its SHA-256.  Rows equal in id and text count once.
    Findings of rows with a null id are given with a null doc_id.  Documents of
    which nothing was found have no row; null texts are left out.
    `increments` are sets of rules under which parts of the documents, dealt by
    content, are scanned before all of them are: as if the table had grown and
    the rules with it.  The result is the same.
    """
    ledger, versions = _ledger(docs, path)
    for k, then in enumerate(increments):
        ledger.scan(versions.where(F.pmod(F.xxhash64("text"), F.lit(len(increments) + 1)) <= k), then)
    ledger.scan(versions, rules)
    found = ledger.by_path(rules)
    return found.select(F.col("path").cast("long").alias("doc_id"), "rule", F.sha2("secret", 256).alias("secret_sha256"), "n_hits", F.lower(F.hex("blob")).alias("blob"))


def redact_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, path: str | None = None) -> DataFrame:
    """`docs` with every secret replaced by `MASK` in the texts of the blobs that have findings; n_chars, if there, is recounted.

    No row is dropped; null texts are unchanged.
    """
    ledger, versions = _ledger(docs, path)
    ledger.scan(versions, rules)
    bad = ledger.findings.where(F.col("rule").isin([r.key for r in rules])).select("blob").distinct()
    blob, hit, masked = apart(docs, "__blob", "__bad", "__clean")
    bad = maybe_broadcast(bad.select(F.col("blob").alias(blob), F.lit(True).alias(hit)), bad.count(), 64)
    text = docs["text"]
    joined = docs.join(bad, F.unhex(F.sha2(text.cast("string"), 256)) == F.col(blob), "left")
    clean = text
    for r in rules:
        clean = F.regexp_replace(clean, F.lit(r.pattern), F.lit(MASK.replace("$", "\\$")))
    joined = joined.withColumn(masked, F.when(F.col(hit), clean).otherwise(text))
    columns = [F.col(masked).alias(c) if c == "text" else F.when(F.col(hit), F.char_length(masked)).otherwise(docs[c]).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else docs[c] for c in docs.columns]
    return joined.select(*columns)


def oracle_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same findings in DuckDB SQL, without a ledger."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    parts = [f"select doc_id, text, {quoted(r.key)} as rule, unnest(regexp_extract_all(text, {quoted(r.pattern)})) as secret from rows" for r in rules]
    return (
        "with rows as (select distinct doc_id, text from documents where text is not null), hits as (" + " union all ".join(parts) + ") "
        "select doc_id, rule, sha256(secret) as secret_sha256, count(*) as n_hits, sha256(text) as blob from hits group by doc_id, rule, secret, text"
    )
