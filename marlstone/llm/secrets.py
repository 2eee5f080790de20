"""Secret scanning with an incremental, content-addressed ledger.

Method: every historical version of every path is addressed by the SHA-256 of
its text.  A ledger has a row for each scanned blob with the rule versions it
was scanned under and the spans they found; only pairs of a blob and a rule
version that the ledger lacks are scanned, each distinct blob once, and the
findings are joined back to all paths that ever held the blob.

DataFrame functions only.  Positions come from the lengths of the matches and
of the text between them, summed over the matches of a blob and rule.  A blob
that a third of all rows hold is reduced before the shuffle (a first value per
task), and its findings join back to narrow rows, which Spark splits if skewed.

Spans count code points, with an exclusive end.  Defined cases: a null text is
an empty one; repeated rows and null paths give a row each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import broadcast_if_small, stored, table


@dataclass(frozen=True)
class Rule:
    """A kind of secret.  ``group`` must have ``shortest`` characters; a text without any of ``needs`` (lower case) has no match."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    shortest: int = 1
    needs: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: In the order in which spans with one start are listed.  Formats as their issuers publish them.
RULES = (
    Rule("assign", 1, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6, ("passw", "secret", "token", "apikey", "api_key")),
    Rule("access", 1, "AKIA[A-Z0-9]+", 0, 20, ("akia",)),
    Rule("hex", 1, "[0-9a-f]{24,}", 0, 24),
    Rule("private_key", 1, "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1, ("private key-----",)),
    Rule("forge_token", 1, "gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("chat_token", 1, "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15, ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-")),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}", 0, 1, ("eyj",)),
)
BASE = ("assign", "access", "hex")

SPAN = "array<struct<start:long,no:int,kind:string,end:long>>"


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def versions_of(rows: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """path, blob, text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return rows.select(F.col(path_col).alias("path"), F.sha2(text, 256).alias("blob"), text.alias("text"))


def _matches(rule: Rule) -> Column:
    """Lengths of the gap before each match, the match and its group, in order; null where there is none."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    zipped = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"),
        F.transform(found, F.length).alias("len"),
        F.transform(value, F.length).alias("val"),
    )
    may = F.array_contains("todo", rule.key)
    if rule.needs:
        may &= _any([F.contains(F.col("low"), F.lit(x)) for x in rule.needs])
    return F.when(may & F.col("text").rlike(rule.pattern), zipped)


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, spans, scanned (rule versions) of distinct ``blobs`` (blob, text, todo: rule versions to scan for)."""
    per_rule = F.array(*[F.struct(F.lit(k).alias("no"), F.lit(r.kind).alias("kind"), F.lit(r.shortest).alias("shortest"), _matches(r).alias("m")) for k, r in enumerate(rules)])
    rows = blobs.withColumn("low", F.lower("text")).select("blob", "todo", F.explode(per_rule).alias("r")).where(F.size("r.m") > 0)
    each = rows.select("blob", "r.no", "r.kind", "r.shortest", F.posexplode("r.m").alias("i", "x"))
    before = Window.partitionBy("blob", "no").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)  # of one text
    end = F.sum(F.col("x.gap") + F.coalesce("x.len", F.lit(0))).over(before)
    spans = each.select("blob", "no", "kind", "shortest", "x", end.alias("end")).where(F.col("x.len").isNotNull() & (F.col("x.val") >= F.col("shortest")))
    span = F.struct((F.col("end") - F.col("x.len")).cast("long").alias("start"), F.col("no"), F.col("kind"), F.col("end").cast("long").alias("end"))
    return spans.groupBy("blob").agg(F.array_sort(F.collect_list(span)).cast(SPAN).alias("spans"))  # of one text


def scan_history(rows: DataFrame, path_col: str, text_col: str, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Scan what ``ledger`` (blob, scanned, spans) lacks; spans per row (path, blob, spans), and the ledger with the new blobs and rule versions.

    Findings of rule versions that are no longer in ``rules`` stay in the
    ledger and are not reported.
    """
    keys = F.array(*[F.lit(r.key) for r in rules])
    texts = versions_of(rows, path_col, text_col)
    blobs = texts.select("blob", "text")
    if ledger is None:
        todo = blobs.groupBy("blob").agg(F.first("text").alias("text")).withColumn("todo", keys)
        old = None
    else:
        old = ledger.select("blob", "scanned", "spans")
        known = old.select("blob", "scanned")
        pending = texts.select("blob").distinct().join(known, "blob", "left").select("blob", F.when(F.col("scanned").isNull(), keys).otherwise(F.array_except(keys, "scanned")).alias("todo")).where(F.size("todo") > 0)
        todo = blobs.join(pending, "blob").groupBy("blob").agg(F.first("text").alias("text"), F.first("todo").alias("todo"))
    # A row for every scanned blob, found or not: its text is no longer needed.
    found = scan_blobs(todo, rules)
    if old is None:
        hits = stored(found, "findings")
        new_ledger = texts.select("blob").distinct().join(hits, "blob", "left").select("blob", keys.alias("scanned"), F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))
    else:
        found = stored(found, "findings")
        empty = F.array().cast(SPAN)
        fresh = pending.join(found, "blob", "left").select("blob", F.col("todo").alias("new"), F.coalesce("spans", empty).alias("more"))
        new_ledger = old.join(fresh, "blob", "full").select(
            "blob",
            F.array_distinct(F.concat(F.coalesce("scanned", F.array().cast("array<string>")), F.coalesce("new", F.array().cast("array<string>")))).alias("scanned"),
            F.array_sort(F.concat(F.coalesce("spans", empty), F.coalesce("more", empty))).alias("spans"),
        )
        new_ledger = stored(new_ledger, "ledger")
        hits = new_ledger.where(F.size("spans") > 0).select("blob", F.filter("spans", lambda s: s.kind.isin([r.kind for r in rules])).alias("spans"))
    by_path = texts.select("path", "blob").join(hits, "blob", "left").select("path", "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))
    return by_path, new_ledger


def as_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def redacted(docs: DataFrame, by_path: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each found span replaced; n_chars follows, where there is such a column.

    The columns of ``docs`` may have any names: they travel in a struct.
    """
    hits = stored(by_path.where(F.size("spans") > 0).select("path", "blob", "spans").dropDuplicates(["path", "blob"]), "hits")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    text = F.col("doc")[text_col]
    # Spans may overlap: each piece starts where all spans before it have ended.
    start = F.struct(F.lit(1).cast("long").alias("at"), F.lit("").alias("out"))
    done = F.aggregate(
        "spans",
        start,
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"] + 1).alias("at"),
            F.when(s["start"] + 1 < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substring(text, acc["at"].cast("int"), (s["start"] + 1 - acc["at"]).cast("int")), F.lit(mark))).alias("out"),
        ),
    )
    blob = F.sha2(F.coalesce(text, F.lit("")), 256)
    joined = rows.join(broadcast_if_small(hits, hits.count()), F.col("doc")[id_col].eqNullSafe(F.col("path")) & (blob == F.col("blob")), "left")
    found = F.col("spans").isNotNull()
    new = F.when(found, F.concat(done["out"], F.substring(text, done["at"].cast("int"), F.lit(2147483647)))).otherwise(text)
    out = joined.select("doc", found.alias("found"), new.alias("new"))
    length = F.when(F.col("found"), F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc")["n_chars"]) if "n_chars" in docs.columns else None
    return out.select(*[F.col("new").alias(c) if c == text_col else length.alias(c) if c == "n_chars" else F.col("doc")[c].alias(c) for c in docs.columns])


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_path, _ = scan_history(table(spark, sf_dir, "documents"), "doc_id", "text")
    base = F.filter("spans", lambda s: s.kind.isin(list(BASE)))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    return by_path.select(F.col("path").alias("doc_id"), *[count(k) for k in BASE], F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))
