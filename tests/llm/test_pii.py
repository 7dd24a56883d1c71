"""Spans against Python's re with the plain patterns, added kinds, masks and odd rows."""

import hashlib
import random
import re

from lumigrid.llm import pii, queries

SCHEMA = "doc_id long, text string, spans string, whole string"
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
         "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def good(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def plain(text):
    found = [f"{kind}:{m.start()}:{m.end()}" for kind, p in PLAIN.items()
             for m in re.finditer(p, text) if good(kind, m.group())]
    counts = [sum(f.startswith(kind + ":") for f in found) for kind in PLAIN]
    return (*counts, hashlib.sha256(",".join(found).encode()).hexdigest())


def card(prefix):
    return next(prefix + str(c) for c in range(10) if luhn(re.sub("[^0-9]", "", prefix + str(c))))


TEXTS = [None, "", "a@b.c", "é🙂 x.y+z@mail-1.example.com_foo@bar.org@baz.net", "a@b.com.x@y.zz", "no@dot a@b",
         "1.2.3.4 1.2.3.4.5.6.7.8 300.1.1.1 255.255.255.255 000255.0.0.1 1.2.3", card("411111111111111"),
         "x" + card("4111 1111 1111 111") + "-" + "9", "1234-5678-9012-3456", "+1 (802) 555-9869 +12 +1----------2",
         "+49 30 1234567.8.9 and +1234567890123456", "." * 2000 + "@", "9" * 30_000, ("a" * 50_000) + "@b.cd",
         "1 " * 20_000, " ".join(["10.0.0.1", "q@r.st", "+15550001111"] * 400), "5" * 200 + ".1.2.3"]


def test_base_kinds_on_odd_texts(spark):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(None, "q@r.st", None, None)] * 2, SCHEMA)
    rows = pii.report(df).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = "q@r.st" if r["doc_id"] is None else TEXTS[r["doc_id"]] or ""
        assert tuple(r[1:6]) == plain(text), (r, text[:80])


def test_base_kinds_on_random_texts(spark):
    random.seed(5)
    texts = ["".join(random.choice(["1", "25", "4", ".", "-", " ", "+", "@", "a", "b.c", "(", "_", "é", "192.168"])
                     for _ in range(random.randrange(60))) for _ in range(400)]
    rows = pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        assert tuple(r[1:6]) == plain(texts[r["doc_id"]]), texts[r["doc_id"]]


def spans(spark, text):
    return pii.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["spans"]


def test_added_kinds_need_check_and_context(spark):
    assert spans(spark, "IBAN GB82 WEST 1234 5698 7654 32 here") == "iban:5:32"
    assert spans(spark, "IBAN GB83 WEST 1234 5698 7654 32 here") == ""
    assert spans(spark, "my SSN is 123-45-6789.") == "ssn:10:21" and spans(spark, "lot 123-45-6789.") == ""
    assert spans(spark, "call (802) 555-9869 now") == "national:5:19" and spans(spark, "sum 802 555 9869") == ""


def test_masks(spark):
    df = spark.createDataFrame([(1, "é a@b.cd, 10.0.0.1@x.yz and +1 802 555 9869.", "s", "w"), (2, None, None, None),
                                (3, "clean", "s", "w"), (4, "", "s", "w"), (5, "a@b.cd", "s", "w")], SCHEMA)
    out = pii.masked(df)
    assert out.columns == df.columns
    assert [r["text"] for r in out.orderBy("doc_id").collect()] == [
        "é [EMAIL], [EMAIL] and [PHONE].", None, "clean", "", "[EMAIL]"]


def test_running_sums(spark):
    rows = [(list(range(n)),) for n in (0, 1, 2, 127, 128, 129, 1000)]
    got = spark.createDataFrame(rows, "a array<int>").select("a", pii.running_sums(pii.F.col("a")).alias("s")).collect()
    for r in got:
        assert r["s"] == [sum(r["a"][:i]) for i in range(len(r["a"]))]


def test_plan_has_no_python(spark, fixture_dir, capsys):
    df = queries.op9_pii_spans(spark, fixture_dir)
    df.explain()
    assert "Python" not in capsys.readouterr().out and "Arrow" not in df._jdf.queryExecution().toString()


def test_empty(spark):
    assert pii.report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark, fixture_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{fixture_dir}/documents.parquet").collect()}
    for r in queries.op9_pii_spans(spark, fixture_dir).collect():
        assert tuple(r[1:6]) == plain(texts[r["doc_id"]])
