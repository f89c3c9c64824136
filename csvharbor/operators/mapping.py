"""Header mapping for whole landing zones: one row per file with its header as an array, many templates at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from csvharbor.functions.cells import trim
from csvharbor.functions.messages import normalized_header
from csvharbor.operators.joins import lookup_join, small_side
from csvharbor.session import cut

MATCH_THRESHOLD = 0.7
AUTO_APPLY_THRESHOLD = 0.9
MAX_SCORE = 5


def file_headers(cells: DataFrame) -> DataFrame:
    """(file, position, name) rows to one ordered array per file; a header is as wide as its file."""
    ordered = F.sort_array(F.collect_list(F.struct("position", "name")))
    return cells.groupBy("table_key", "file").agg(F.transform(ordered, lambda x: x["name"]).alias("headers"))


def _simplified(names: Column) -> Column:
    return F.transform(names, lambda n: F.lower(trim(n)))


def overlap(template_headers: Column, headers: Column) -> Column:
    """Share of the template's headers that the file has."""
    present = _simplified(headers)
    matched = F.size(F.filter(_simplified(template_headers), lambda h: F.array_contains(present, h)))
    total = F.size(template_headers)
    return F.when(total > 0, matched / total).otherwise(F.lit(0.0))


def _probes(templates: DataFrame, spread: DataFrame, threshold: float) -> DataFrame:
    """The rarest headers of each template, as many as any file that fits must share one of.

    A file without any of them has less than the threshold of the template, so it need not be scored.
    """
    words = templates.select("table_key", "template_id", F.size("csv_headers").alias("total"), F.explode(_simplified(F.col("csv_headers"))).alias("header"))
    words = words.groupBy("table_key", "template_id", "total", "header").agg(F.count("*").alias("times"))
    seen = spread.groupBy("table_key", "header").agg(F.count("*").alias("files"))
    words = words.join(seen, ["table_key", "header"], "left")
    rarer = Window.partitionBy("table_key", "template_id").orderBy(F.coalesce("files", F.lit(0)), "header").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("times").over(rarer), F.lit(0))
    needed = words.withColumn("before", before).filter(F.col("before") <= F.col("total") * (1 - threshold) + 1e-9)
    return needed.filter(F.col("files").isNotNull()).select("table_key", "header", "template_id")


def match_templates(files: DataFrame, templates: DataFrame, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """Templates of the file's table that fit, scored. Files with equal headers are scored once."""
    files = files.withColumn("signature", F.array_sort(F.array_distinct(_simplified(F.col("headers")))))
    shapes = cut(files.select("table_key", "signature").distinct())
    spread = shapes.select("table_key", "signature", F.explode("signature").alias("header"))
    probes = cut(_probes(templates, spread, threshold))
    pairs = spread.join(small_side(probes), ["table_key", "header"]).select("table_key", "signature", "template_id").distinct()
    scored = pairs.join(small_side(templates.select("table_key", "template_id", "csv_headers")), ["table_key", "template_id"])
    scored = scored.withColumn("score", overlap(F.col("csv_headers"), F.col("signature"))).filter(F.col("score") >= threshold)
    fits = cut(scored.groupBy("table_key", "signature").agg(F.collect_list(F.struct("template_id", "score")).alias("fits")))
    matched = lookup_join(files, fits, ["table_key", "signature"])
    return matched.select("table_key", "file", F.inline("fits"))


def _candidates(expected: str, headers: Column) -> Column:
    """(score, tie, position) per header: 0 exact, half the length gap if one contains the other, else edit distance."""
    want = normalized_header(F.lit(expected))

    def rate(header: Column, at: Column) -> Column:
        have = normalized_header(header)
        gap = F.abs(F.length(have) - F.length(want)) * F.lit(0.5)
        distance = F.levenshtein(want, have) / F.greatest(F.length(want), F.length(have)) * F.lit(10)
        contains = F.contains(have, want) | F.contains(want, have)
        score = F.when(have == want, F.lit(0.0)).when(contains, gap).otherwise(distance)
        # Among exact matches the last header counts, otherwise the first of equal scores.
        tie = F.when(have == want, -at).otherwise(at)
        return F.struct(score.cast("double").alias("score"), tie.alias("tie"), at.alias("position"))

    return F.transform(headers, rate)


def _best_position(expected: str, headers: Column) -> Column:
    best = F.array_min(_candidates(expected, headers))
    return F.when(best["score"] <= MAX_SCORE, best["position"]).otherwise(F.lit(-1))


def suggest_mapping(files: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Best header position per expected column and file, -1 where none is close enough."""
    suggested = [
        F.struct(F.lit(name).alias("expected"), F.lit(i).alias("expected_no"), _best_position(name, F.col("headers")).alias("position"))
        for i, name in enumerate(expected)
    ]
    return files.select("table_key", "file", F.inline_outer(F.array(*suggested)))


def auto_mapping(files: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Suggestions in expected order, each header used once; a column whose best is taken stays unmapped."""
    ranked = files.withColumn("best", F.array(*[_best_position(name, F.col("headers")) for name in expected]))
    chosen = [
        F.struct(
            F.lit(name).alias("expected"),
            F.lit(i).alias("expected_no"),
            F.when(F.array_position("best", F.col("best")[i]) == i + 1, F.col("best")[i]).otherwise(F.lit(-1)).alias("position"),
        )
        for i, name in enumerate(expected)
    ]
    return ranked.select("table_key", "file", F.inline_outer(F.array(*chosen)))


def initial_mapping(files: DataFrame, templates: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Per file the mapping of its best template if that fits well enough, else the automatic one."""
    fits = match_templates(files, templates, AUTO_APPLY_THRESHOLD)
    best = fits.groupBy("table_key", "file").agg(F.max_by("template_id", F.struct("score", "template_id")).alias("template_id"))
    chosen = best.join(small_side(templates.select("template_id", "column_mapping")), "template_id")
    automatic = auto_mapping(files, expected).join(best, ["table_key", "file"], "left_anti")
    rows = [
        F.struct(
            F.lit(name).alias("expected"),
            F.lit(i).alias("expected_no"),
            F.coalesce(F.try_element_at("column_mapping", F.lit(name)), F.lit(-1)).alias("position"),
        )
        for i, name in enumerate(expected)
    ]
    from_template = chosen.select("table_key", "file", "template_id", F.inline_outer(F.array(*rows)))
    return from_template.unionByName(automatic.withColumn("template_id", F.lit(None).cast("string")), allowMissingColumns=True)


def headers_equal(headers: Column, expected: Sequence[str]) -> Column:
    """Same names in the same order, in any case, and no others."""
    return F.transform(headers, F.lower) == F.array(*[F.lit(e.lower()) for e in expected])


def decode_templates(raw: DataFrame) -> DataFrame:
    """Template JSON columns to a name-to-position map and a header array."""
    return raw.withColumn("column_mapping", F.from_json("column_mapping", "map<string,int>")).withColumn(
        "csv_headers", F.from_json("csv_headers", "array<string>")
    )
