"""Secret scans over a ledger of content-addressed texts.

Every version of every text is addressed by its SHA-256, every version of the rules by a hash of them. The ledger, a
Parquet folder, holds a row for each pair of blob and rule version that was ever scanned, with the spans found. A scan takes the distinct blobs of its input,
leaves out the pairs that the ledger holds, searches the rest and appends them; findings then go back to all paths
by address. All of it is DataFrame functions.

Positions come from splitting: between the pieces of ``split(text, rule)`` stand the matches of
``regexp_extract_all(text, rule)``, so running sums of their lengths are the spans, in code points.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, materialize, new_folder, table

SPANS = "array<struct<start:long,kind:int,end:long>>"
LEDGER = f"blob string, rules string, spans {SPANS}"


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches are leftmost and non-overlapping; those whose group is shorter than least are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: Fixed values of the base rules. Runs that must be long enough are searched as such where that gives the same spans.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: What the ledger's rule version adds to them: formats of well-known public token kinds.
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("url", r"://[^\s/:@]{1,64}:[^\s/:@]{1,64}@"),
)
RULES = BASE + ADDED
_KEY = r"[A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
#: What is masked: the rules, but keys with their bodies (to the END line, or without one to the end of the base64 lines)
#: and links with credentials of any length. Their patterns are Java's only, so the scans keep RULES.
MASKED = tuple(
    {
        "pem": Rule(
            "pem",
            rf"-----BEGIN {_KEY}(?:(?>[\s\S]*?(?=-----))-----END {_KEY}|(?:\r?\n[A-Za-z-]+: [^\n]*)*+(?:\s+[A-Za-z0-9+/]{{16,}}+={{0,2}})*+(?:\r?\n[A-Za-z0-9+/]+={{0,2}}(?=[\r\n]|\z))?)",
        ),
        "url": Rule("url", r"://[^\s/:@]+:[^\s/:@]+@"),
    }.get(r.kind, r)
    for r in RULES
)


def version_of(rules: tuple[Rule, ...], label: str = "") -> str:
    """Names a set of rules: another pattern, group, length, order or label is another version."""
    return hashlib.sha256(repr((label, [(r.kind, r.pattern, r.group, r.least) for r in rules])).encode()).hexdigest()[:16]


def rule_spans(text: Column, rule: Rule, number: int) -> Column:
    """Array of (start, kind's number, end) of a rule's kept matches in a text."""
    pattern = F.lit(rule.pattern)
    found, kept = F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(rule.group))
    parts = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), found.alias("hit"), kept.alias("value"))
    none = F.array().cast(SPANS)

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["gap"])
        end = start + F.coalesce(F.length(part["hit"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"))
        add = F.when(F.length(part["value"]) >= rule.least, F.array(span)).otherwise(none)
        return F.struct(end.alias("at"), F.concat(state["spans"], add).alias("spans"))

    first = F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans"))
    folded = F.aggregate(parts, first, step, lambda s: s["spans"])
    return F.when(text.rlike(rule.pattern), folded).otherwise(none)


def find_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans of a text, by start and then by the rules' order."""
    return F.array_sort(F.concat(*(rule_spans(text, r, k) for k, r in enumerate(rules))))


def scan(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, version: str = "", text_col: str = "text") -> None:
    """Adds to the ledger every blob of docs that it lacks under these rules. A null text is the empty one.

    Scans that run at the same time may add a pair twice; readers take one of them.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    blobs = docs.select(F.sha2(text, 256).alias("blob"), text.alias("text")).groupBy("blob").agg(F.any_value("text").alias("text"))
    known = read_ledger(spark, ledger)
    if known is not None:
        blobs = blobs.join(known.where(F.col("rules") == version_of(rules, version)).select("blob"), "blob", "left_anti")
    blobs.select("blob", F.lit(version_of(rules, version)).alias("rules"), find_spans(F.col("text"), rules).alias("spans")).write.mode("append").parquet(ledger)


def read_ledger(spark, ledger: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(LEDGER).parquet(ledger)


def findings(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, version: str = "", text_col: str = "text", name: str = "secret_spans") -> DataFrame:
    """docs with one more column: the spans of its text. It replaces a column of its name; all others stay.

    Scans what the ledger lacks first; without a ledger a new one is made in the shared folder. Every row stays, repeated
    ones and those without an id too; null and empty texts have no spans; an empty table gives none. Very long texts are
    searched whole.
    """
    given, ledger = ledger, ledger or new_folder(docs.sparkSession, "ledger")
    scan(docs, ledger, rules, version, text_col)
    (blob,) = free_names(docs, "__blob")
    known = read_ledger(docs.sparkSession, ledger).where(F.col("rules") == version_of(rules, version))
    if given:  # others may have added a pair too; written first, so that Spark can split a hot address of the join below
        known = materialize(known.groupBy("blob").agg(F.any_value("spans").alias("spans")), "known")
    known = known.select(F.col("blob").alias(blob), F.col("spans").alias(name))
    address = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)
    return docs.drop(name).withColumn(blob, address).join(known, blob).drop(blob)


def redact(text: Column, spans: Column, mark: str = "<SECRET>") -> Column:
    """The text with each run of overlapping spans replaced by the mark."""
    first = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(state: Column, span: Column) -> Column:
        between = F.substring(text, (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
        out = F.when(span["start"] >= state["at"], F.concat(state["out"], between, F.lit(mark))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), out.alias("out"))

    rest = lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, first, step, rest)).otherwise(text)


def joined(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def op1_secret_scans(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.col("secret_spans")
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    base = F.filter(spans, lambda s: s["kind"] < len(BASE))
    return findings(docs).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans")
    )


def _duckdb_spans(rule: Rule, number: int) -> str:
    """A list of (start, kind's number, end) of one rule, from the gaps between its matches and the matches."""
    p = "'" + rule.pattern.replace("'", "''") + "'"
    gaps, hits, kept = f"string_split_regex(t, {p})", f"regexp_extract_all(t, {p}, 0)", f"regexp_extract_all(t, {p}, {rule.group})"
    lengths = lambda x, upto: f"coalesce(list_sum([length(y) for y in ({x})[1:{upto}]]), 0)"
    start = f"CAST({lengths(gaps, 'i')} + {lengths(hits, 'i - 1')} AS BIGINT)"
    kind = rule.kind
    return f"[{{'s': {start}, 'k': {number}, 'e': {start} + length(({hits})[i]), 'n': '{kind}'}} for i in range(1, len({hits}) + 1) if length(({kept})[i]) >= {rule.least}]"


#: DuckDB, from the same rules.
OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, list_sort(list_concat({", ".join(_duckdb_spans(r, k) for k, r in enumerate(RULES[:3]))})) AS base, list_concat({", ".join(_duckdb_spans(r, k + 3) for k, r in enumerate(RULES[3:]))}) AS added FROM d),
g AS (SELECT doc_id, base, list_sort(list_concat(base, added)) AS every FROM f)
SELECT doc_id, CAST(len([x for x in base if x.k = 0]) AS BIGINT) AS n_assign, CAST(len([x for x in base if x.k = 1]) AS BIGINT) AS n_access, CAST(len([x for x in base if x.k = 2]) AS BIGINT) AS n_hex,
  sha256(coalesce(array_to_string([x.n || ':' || x.s || ':' || x.e for x in base], ','), '')) AS base_sha256, coalesce(array_to_string([x.n || ':' || x.s || ':' || x.e for x in every], ','), '') AS spans FROM g
"""
