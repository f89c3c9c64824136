"""Secret scans against Python's regular expressions, and what the ledger spares."""

import random
import re

import pytest
from pyspark.sql import functions as F

from csvharbor.llm import secrets

HEX, KEY = "0123456789abcdef" * 2, "AKIA" + "Q7" * 8


def brute(text, rules=secrets.RULES):
    out = []
    for order, rule in enumerate(rules, 1):
        for m in re.finditer(rule.pattern, text or "", re.ASCII):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), order, rule.kind, m.end()))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "b", ["r"]) for i, t in rows], "doc_id long, body string, blob string, rules array<string>")


def spans(spark, tmp_path, rows, **more):
    found = secrets.Ledger(spark, str(tmp_path)).scan(frame(spark, rows), "doc_id", "body", **more).collect()
    return sorted(((r.id, [tuple(s) for s in r.spans]) for r in found), key=str)


TEXTS = [
    None, "", "plain words", 'PassWord = "hunter22" and token:short', "token=token\"=abcdefg", "api_key: 'A1b2c3d4' APIKEY=zzzzzz", "secret==abc secret=abcdef=",
    f"é𝄞 {KEY} x{HEX}y {HEX.upper()}", "AKIA" * 6, "AKIAAKIASHORT", HEX[:23] + " " + HEX[:24], f"token={HEX}", "-----BEGIN RSA PRIVATE KEY-----",
    "https://me:pw@host ftp://a:b@c http://host:80/x", "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl", "ghp_" + "a1" * 18, "\n".join(["secret: abcdef1"] * 40), " " * 5000 + "token" + " " * 5000,
]


def test_spans_of_odd_texts(spark, tmp_path):
    rows = [*enumerate(TEXTS), (3, TEXTS[3]), (None, TEXTS[7]), (None, None)]
    assert spans(spark, tmp_path, rows) == sorted(((i, brute(t)) for i, t in rows), key=str)
    assert not brute(TEXTS[4]) and all(brute(t) for t in (TEXTS[3], *TEXTS[5:9], *TEXTS[10:16]))


def test_random_texts(spark, tmp_path):
    rng = random.Random(8)
    atoms = ["token", "Secret", "passwd", "api-key", "apikey", "=", ":", " ", "  ", '"', "'", "abcdef", "12345", "AKIA", "A9Z", HEX[:9], "deadbeef", "ü", "😀", "\n", "."]
    rows = [(k, "".join(rng.choices(atoms, k=rng.randint(1, 60)))) for k in range(400)]
    assert spans(spark, tmp_path, rows) == sorted(((i, brute(t)) for i, t in rows), key=str)


def test_long_text_with_many_matches(spark, tmp_path):
    text = "x ".join(f"token={k:06d}{HEX}" for k in range(20_000))
    assert spans(spark, tmp_path, [(1, text)]) == [(1, brute(text))]


def test_empty_table(spark, tmp_path):
    assert spans(spark, tmp_path, []) == []


def scanned(ledger):
    return sorted((r.batch, bytes(r.blob).hex()[:6], tuple(sorted(x.split("@")[0] for x in r.rules))) for r in ledger._read("scanned", secrets.SCANNED).collect())


@pytest.mark.parametrize("small", [secrets.SMALL_ROWS, 0])
def test_only_unseen_pairs_are_scanned(spark, tmp_path, monkeypatch, small):
    monkeypatch.setattr(secrets, "SMALL_ROWS", small)
    ledger = secrets.Ledger(spark, str(tmp_path))
    first = [(k, TEXTS[k % 9]) for k in range(30)]
    ledger.scan(frame(spark, first), "doc_id", "body", secrets.BASE, "one")
    one = scanned(ledger)
    assert len(one) == 8  # null and empty texts are one blob
    second = [(k, TEXTS[k % 11]) for k in range(40, 80)]
    found = ledger.scan(frame(spark, second), "doc_id", "body", secrets.BASE, "two")
    assert len([s for s in scanned(ledger) if s[0] == "two"]) == 2
    assert sorted((r.id, [tuple(s) for s in r.spans]) for r in found.collect()) == sorted((i, brute(t, secrets.BASE)) for i, t in second)
    # A new version of one rule runs alone over the blobs that the batch names, and the old version's findings do not count.
    changed = (secrets.Rule("assign", secrets.BASE[0].pattern, 2, 8), *secrets.BASE[1:])
    found = ledger.scan(frame(spark, second), "doc_id", "body", changed, "three")
    three = [s for s in scanned(ledger) if s[0] == "three"]
    assert len(three) == 10 and {s[2] for s in three} == {("assign",)}
    assert sorted((r.id, [tuple(s) for s in r.spans]) for r in found.collect()) == sorted((i, brute(t, changed)) for i, t in second)
    before = ledger.exposures(secrets.BASE, "long").count()
    again = ledger.scan(frame(spark, second), "doc_id", "body", secrets.BASE, "two")  # a retried batch
    assert again.count() == 40 and ledger.exposures(secrets.BASE, "long").count() == before
    assert before == sum(len(brute(t, secrets.BASE)) for _, t in first + second * 2)


def test_a_stop_before_the_note_is_made_up_for(spark, tmp_path, monkeypatch):
    ledger = secrets.Ledger(spark, str(tmp_path))
    write = secrets.Ledger._write
    monkeypatch.setattr(secrets.Ledger, "_write", lambda self, df, name, batch: (_ for _ in ()).throw(OSError("lost")) if name == "scanned" else write(self, df, name, batch))
    with pytest.raises(OSError):
        ledger.scan(frame(spark, [(1, TEXTS[3])]), "doc_id", "body", batch="a")
    monkeypatch.setattr(secrets.Ledger, "_write", write)
    for batch in ("b", "a"):
        found = ledger.scan(frame(spark, [(1, TEXTS[3])]), "doc_id", "body", batch=batch).collect()
        assert [tuple(s) for s in found[0].spans] == brute(TEXTS[3])


def test_built_in_functions_only(spark, tmp_path):
    plan = secrets.Ledger(spark, str(tmp_path)).scan(frame(spark, [(1, "token=abcdef")]), "doc_id", "body").select(secrets.shown(F.col("spans")))
    assert not re.search("Python|Pandas|Arrow", plan._jdf.queryExecution().executedPlan().toString())
