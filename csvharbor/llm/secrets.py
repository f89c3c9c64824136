"""Secret scans through a ledger of text blobs, in built-in functions only.

A text is known by its SHA-256, whatever its paths and versions. The ledger remembers which rules, each known by a digest of
its definition, have been run over which blob; a scan runs only what is missing, over one copy of every blob, and joins what
is found in a blob back to every row that holds it.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from csvharbor.llm.quality import bound
from csvharbor.operators.joins import is_small, lookup_join
from csvharbor.session import cut

SMALL_ROWS = 50_000
SCANNED = "blob binary, rules array<string>, batch string"
FINDINGS = "blob binary, rule string, start int, `end` int, batch string"
PIECES = "array<struct<rule:string,k:int,gap:int,length:int,good:boolean>>"


@dataclass(frozen=True)
class Rule:
    """Matches of a pattern, leftmost and without overlap; those whose ``group`` has fewer than ``least`` characters go."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def name(self) -> str:
        """Another definition is another version of the rule."""
        return f"{self.kind}@{hashlib.sha256(repr((self.pattern, self.group, self.least)).encode()).hexdigest()[:16]}"


# What the kinds look like. The length that access and hex ask for is part of their patterns.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
)
ADDED = (
    Rule("pem", "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", "gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("login", r"(?:https?|ftp|ssh|postgres|mysql|mongodb|redis|amqp)://[^\x00-\x20/:@]+:[^\x00-\x20/@]+@"),
)
RULES = (*BASE, *ADDED)


def _pieces(text: Column, rule: Rule) -> Column:
    """Every match with the length of what lies between it and the one before it."""

    def measured(matches: Column) -> Column:
        kept = F.char_length if not rule.group else lambda m: F.char_length(F.regexp_extract(m, rule.pattern, rule.group))
        return bound(
            F.split(text, rule.pattern, -1),
            lambda gaps: F.transform(
                matches,
                lambda m, k: F.struct(
                    F.lit(rule.name).alias("rule"), k.alias("k"), F.char_length(F.get(gaps, k)).alias("gap"),
                    F.char_length(m).alias("length"), (kept(m) >= rule.least).alias("good"),
                ),
            ),
        )

    return bound(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, measured(m)).otherwise(F.array().cast(PIECES)))


@dataclass
class Ledger:
    """Three tables under ``root``, each by batch: rows' blobs, what has been scanned, and what was found."""

    spark: SparkSession
    root: str

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(os.path.join(self.root, name))
        except AnalysisException as none:
            if none.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, name: str, batch: str) -> DataFrame:
        path = os.path.join(self.root, name, f"batch={batch}")
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def versions(self, kind: str = "string") -> DataFrame:
        """``id, blob, batch`` of every row that was ever scanned; ``kind`` is the type of the ids."""
        return self._read("versions", f"id {kind}, blob binary, batch string")

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """``blob, rule, start, end`` of these versions of the rules; a retried batch gives nothing twice."""
        known = self._read("findings", FINDINGS).where(F.col("rule").isin([r.name for r in rules]))
        return known.select("blob", "rule", "start", "end").distinct()

    def exposures(self, rules: tuple[Rule, ...] = RULES, kind: str = "string") -> DataFrame:
        """``id, batch, rule, start, end``: everything found, at every row of every batch that holds the text."""
        return self.versions(kind).join(self.findings(rules), "blob").select("id", "batch", "rule", "start", "end")

    def scan(self, rows: DataFrame, ident: str, text: str, rules: tuple[Rule, ...] = RULES, batch: str | None = None) -> DataFrame:
        """Scans what no earlier batch has; gives ``id, spans`` for each given row, spans as (start, order, kind, end).

        Spans count in code points, the end exclusive, by start and then the order of the rules. A null text counts as empty
        and holds nothing; rows that repeat are reported one by one, null ids too. Other columns are not looked at. Findings
        are written before the note that their blobs are scanned, and a batch leaves its own notes out of what it knows, so
        that a retried batch repeats the work and ends in the same state. An empty table adds nothing.
        """
        batch, names = batch or uuid.uuid4().hex, [r.name for r in rules]
        content = F.coalesce(F.col(text), F.lit(""))
        given = rows.select(F.col(ident).alias("id"), F.unhex(F.sha2(content, 256)).alias("blob"), content.alias("t"))
        mine = self._write(given.select("id", "blob"), "versions", batch)
        known = self._read("scanned", SCANNED).where(F.col("batch") != batch)
        every = F.array(*map(F.lit, names))
        if known.isEmpty():
            pending = given.groupBy("blob").agg(F.first("t").alias("t")).withColumn("rules", every)
        else:
            # As many rows a blob as batches have run further rules over it.
            past = known.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("past"))
            asked = mine.select("blob").distinct().join(past, "blob", "left")
            left = F.array_except(every, F.coalesce("past", F.array().cast("array<string>")))
            asked = cut(asked.select("blob", left.alias("rules")).where(F.size("rules") > 0))
            if is_small(asked, SMALL_ROWS):  # few texts: they are picked where they lie
                pending = given.join(F.broadcast(asked), "blob").groupBy("blob").agg(F.first("t").alias("t"), F.first("rules").alias("rules"))
            else:
                pending = given.groupBy("blob").agg(F.first("t").alias("t")).join(asked, "blob")
        none = F.array().cast(PIECES)
        pieces = F.flatten(F.array(*[F.when(F.array_contains("rules", r.name), _pieces(F.col("t"), r)).otherwise(none) for r in rules]))
        scanned = cut(pending.select("blob", "rules", pieces.alias("pieces")))
        through = Window.partitionBy("blob", "rule").orderBy("k")
        placed = scanned.select("blob", F.inline("pieces")).withColumn("end", F.sum(F.col("gap") + F.col("length")).over(through).cast("int"))
        found = placed.where("good").select("blob", "rule", (F.col("end") - F.col("length")).alias("start"), "end")
        self._write(found, "findings", batch)
        self._write(scanned.select("blob", "rules"), "scanned", batch)
        order = F.array_position(every, F.col("rule")).cast("int").alias("order")
        # A blob has as many spans as its text has room for.
        spans = F.sort_array(F.collect_list(F.struct("start", order, F.element_at(F.split("rule", "@"), 1).alias("kind"), "end"))).alias("spans")
        held = cut(self.findings(rules).groupBy("blob").agg(spans))
        joined = lookup_join(mine, held, ["blob"], "left")
        return joined.select("id", F.coalesce("spans", F.array().cast(dict(held.dtypes)["spans"])).alias("spans"))


def shown(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _sql() -> str:
    """The same in plain SQL, every text by itself."""
    quoted = lambda text: text.replace("'", "''")
    rules = ", ".join(f"({k}, '{r.kind}', '{quoted(r.pattern)}', {r.group}, {r.least})" for k, r in enumerate(RULES))
    kinds = [r.kind for r in BASE]
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in kinds)
    per_rule = " UNION ALL ".join(
        f"SELECT r, {k} AS rule, regexp_extract_all(t, '{quoted(x.pattern)}') AS m, regexp_split_to_array(t, '{quoted(x.pattern)}') AS g FROM d" for k, x in enumerate(RULES)
    )
    keep = " ".join(f"WHEN {k} THEN length(regexp_extract(m, '{quoted(x.pattern)}', {x.group})) >= {x.least}" for k, x in enumerate(RULES))
    return f"""
WITH rules(rule, kind, pattern, grp, least) AS (VALUES {rules}),
d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
found AS ({per_rule}),
pieces AS (SELECT r, rule, unnest(range(1, len(m) + 1)) AS k, unnest(m) AS m, unnest(g[1:len(m)]) AS g FROM found WHERE len(m) > 0),
placed AS (SELECT r, rule, m, sum(length(g) + length(m)) OVER (PARTITION BY r, rule ORDER BY k) AS e FROM pieces),
spans AS (SELECT r, rule, kind, CAST(e - length(m) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM placed JOIN rules USING (rule) WHERE CASE rule {keep} END),
told AS (
  SELECT r, {counts}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rule) AS spans,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rule) FILTER (rule < {len(BASE)}) AS base FROM spans GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in kinds)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told USING (r)"""


SCAN_SQL = _sql()
