"""Template matching against brute force, and the mapping rules."""

import random

from csvharbor.operators import mapping

EXPECTED = ["account_id", "account_name", "type"]


def brute(files, templates, threshold):
    fits = set()
    for key, file, headers in files:
        have = {h.strip().lower() for h in headers}
        for other, template, names in templates:
            if key == other and names:
                score = sum(n.strip().lower() in have for n in names) / len(names)
                if score >= threshold:
                    fits.add((file, template, round(score, 9)))
    return fits


def test_templates_match_brute_force(spark):
    rng = random.Random(5)
    words = [f"Col {i}" for i in range(14)]

    def names():
        return [rng.choice((str.upper, str.lower, lambda w: f" {w} "))(rng.choice(words)) for _ in range(rng.randint(1, 9))]

    files = [(rng.choice("ab"), f"f{i}", names()) for i in range(150)]
    templates = [(rng.choice("abc"), f"t{i}", names()) for i in range(40)] + [("a", "none", [])]
    f = spark.createDataFrame(files, "table_key string, file string, headers array<string>")
    t = spark.createDataFrame(templates, "table_key string, template_id string, csv_headers array<string>")
    for threshold in (0.7, 0.9, 1.0):
        got = {(r.file, r.template_id, round(r.score, 9)) for r in mapping.match_templates(f, t, threshold).collect()}
        assert got == brute(files, templates, threshold)


def test_rules(spark):
    headers = [
        ("exact", ["Type", "ACCOUNT ID", "account_name"]),
        ("last exact", ["type", "x", "TYPE", "account_id"]),
        ("taken", ["account"]),
        ("far", ["zzzzzzzzzzzzzzzzzz"]),
        ("empty", []),
    ]
    files = spark.createDataFrame([("k", n, h) for n, h in headers], "table_key string, file string, headers array<string>")

    def table(df):
        found = {}
        for r in df.collect():
            found.setdefault(r.file, {})[r.expected] = r.position
        return {n: [found[n][e] for e in EXPECTED] for n in found}

    assert table(mapping.suggest_mapping(files, EXPECTED)) == {
        "exact": [1, 2, 0], "last exact": [3, 3, 2], "taken": [0, 0, -1], "far": [-1, -1, -1], "empty": [-1, -1, -1],
    }
    assert table(mapping.auto_mapping(files, EXPECTED)) == {
        "exact": [1, 2, 0], "last exact": [3, -1, 2], "taken": [0, -1, -1], "far": [-1, -1, -1], "empty": [-1, -1, -1],
    }
