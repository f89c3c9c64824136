"""Quality rules from a text alone and from lines that several documents of a host share, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from csvharbor.operators.joins import lookup_join
from csvharbor.session import cut

BLANKS = " \t\n\x0b\x0c\r"
RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
REPEAT_PERCENT = 20
LINE_DOCUMENTS = 5
DEPLETED_PERCENT = 50


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, whatever the number of its uses."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, RUN))


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """How many words lie in windows of ``width`` words that the text has twice or more.

    Windows are known by 64-bit hashes. Texts without an equal pair end there; for others the windows are sorted with their
    places, and those with an equal neighbour cover ``width`` words each, overlaps counted once.
    """

    def covered(hashes: Column) -> Column:
        def marked(ordered: Column) -> Column:
            last = F.size(ordered) - 1
            alike = lambda k, other: F.get(ordered, other)["h"] == F.get(ordered, k)["h"]
            return F.filter(ordered, lambda e, k: ((k > 0) & alike(k, F.greatest(k - 1, F.lit(0)))) | ((k < last) & alike(k, F.least(k + 1, last))))

        ordered = F.sort_array(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))
        places = F.sort_array(F.transform(bound(ordered, marked), lambda e: e["k"]))
        start = F.struct(F.lit(-width).alias("at"), F.lit(0).cast("long").alias("n"))
        add = lambda a, k: F.struct(k.alias("at"), (a["n"] + F.least(F.lit(width), k - a["at"])).alias("n"))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(F.aggregate(places, start, add, lambda a: a["n"]))

    hashed = lambda w: F.transform(
        F.slice(w, 1, F.greatest(F.size(w) - (width - 1), F.lit(0))), lambda x, k: F.xxhash64(x, *(F.get(w, k + j) for j in range(1, width)))
    )
    return bound(words, lambda w: bound(hashed(w), covered))


def line_facts(text: Column) -> Column:
    """Per line with a word: hash of the normalised line and its length. Case, digits and the width of blanks do not count."""
    normal = lambda line: F.lower(F.regexp_replace(F.regexp_replace(F.btrim(line, F.lit(BLANKS)), RUN, " "), "[0-9]", "0"))
    plain = F.filter(F.transform(F.split(text, "\n"), normal), lambda line: line != "")
    return F.transform(plain, lambda line: F.struct(F.xxhash64(line).alias("h"), F.char_length(line).alias("chars")))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier one."""
    return bound(F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != ""), lambda lines: F.size(lines) - F.size(F.array_distinct(lines)))


def judge(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", host: str = "source", line_documents: int = LINE_DOCUMENTS, depleted_percent: int = DEPLETED_PERCENT
) -> DataFrame:
    """``id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, line_chars, removed_chars, base_failed, kept`` per row.

    A line is removed when more than ``line_documents`` documents of its host have it, whatever the size of the host; a
    document is depleted when more than ``depleted_percent`` per cent of its characters go with such lines. A null text counts
    as empty and fails; null hosts are one host; repeated rows are judged one by one. Other columns are not looked at.

    Lines meet the frequent ones of their host by a join, and only what it takes from a document goes on. Frequent lines
    grow with the corpus: they are broadcast while they are few, and beyond that the lines that very many documents have
    are joined apart from the rest.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    read = docs.select(
        F.col(id_column).alias("id"), F.col(host).isNull().alias("void"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("name"), content.alias("t")
    )
    facts = cut(
        read.select(
            "id", "void", "name", F.monotonically_increasing_id().alias("row"),
            F.char_length(without(F.col("t"), BLANKS)).cast("long").alias("word_chars"),
            (F.char_length("t") - F.char_length(without(F.col("t"), SYMBOLS))).cast("long").alias("n_symbols"),
            duplicate_lines(F.col("t")).cast("long").alias("n_dup_lines"),
            bound(words_of(F.col("t")), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("repeated"))).alias("words"),
            bound(line_facts(F.col("t")), lambda lines: F.struct(
                F.aggregate(lines, F.lit(0).cast("long"), lambda a, line: a + line["chars"]).alias("chars"), lines.alias("each"))).alias("lines"),
        )
    )
    place = ["void", "name", "h"]
    seen = facts.select("void", "name", F.explode(F.array_distinct(F.col("lines.each.h"))).alias("h")).groupBy(*place).agg(F.count("*").alias("n"))
    frequent = cut(seen.where(F.col("n") > line_documents).select(*place))
    lines = facts.select("row", "void", "name", F.explode("lines.each").alias("line")).select("row", "void", "name", "line.h", "line.chars")
    removed = cut(lookup_join(lines, frequent, place).groupBy("row").agg(F.sum("chars").alias("removed_chars")))
    judged = lookup_join(facts.drop("void", "name"), removed, ["row"], "left").select(
        "id", F.col("words.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("words.repeated").alias("n_repeat_words"),
        F.col("lines.chars").alias("line_chars"), F.coalesce("removed_chars", F.lit(0).cast("long")).alias("removed_chars"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    depleted = F.col("removed_chars") * 100 > F.col("line_chars") * depleted_percent
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted).withColumnRenamed("id", id_column)


#: The same in plain SQL, with lines and windows compared as they are.
JUDGE_SQL = r"""
WITH d AS (SELECT doc_id, source, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (SELECT r, i, w[i:i + 4] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
rep AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY r),
raw AS (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d),
solid AS (SELECT r, l FROM raw WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM solid GROUP BY r),
norm AS (SELECT r, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(l, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]', '0', 'g')) AS l FROM solid),
often AS (SELECT d.source, l FROM norm JOIN d USING (r) GROUP BY d.source, l HAVING count(DISTINCT r) > 5),
lines AS (
  SELECT r, sum(length(l)) AS total, sum(CASE WHEN EXISTS (SELECT 1 FROM often o WHERE o.source IS NOT DISTINCT FROM d.source AND o.l = norm.l) THEN length(l) ELSE 0 END) AS gone
  FROM norm JOIN d USING (r) GROUP BY r),
f AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(total, 0)::BIGINT AS line_chars, coalesce(gone, 0)::BIGINT AS removed_chars
  FROM d JOIN w USING (r) LEFT JOIN cov USING (r) LEFT JOIN dup USING (r) LEFT JOIN lines USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT removed_chars * 100 > line_chars * 50 AS kept
FROM f
"""
