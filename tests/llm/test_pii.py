import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import pii

# The contract's patterns, as they are written there.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def valid(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 9 <= len(d) <= 15


def plain(text):
    out = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if valid(k, m[0])]
    return sorted(out)


def base(docs):
    got = pii.find_personal(docs, model=({}, -9.0)).collect()
    return {r.doc_id: [tuple(x) for x in r.base] for r in got}


def test_base_spans(docs_of):
    rng = random.Random(3)
    pieces = ["a@b.c", "a@b.com_x@c.de", "x@y", "@", ".", "..", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "000255.01.1.0", "4111 1111 1111 1111", "4111-1111-1111-1112", "4", "-", " ", "  ", "+", "+1 (017) 555-7713", "+1", "+49.30.1234-5678)", "é", "\U0001f600", "a%b@c-d.e-f.", "12", "0" * 13, "\n", "+1234567890123456", "%%%", "ß@ß.de", "(", ")"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))) for i in range(1500)]
    rows += [(2000, None), (2001, ""), (2002, "x" * 50_000 + "@"), (2003, "a.b" * 20_000 + "@c" + ".d" * 20_000), (2004, "1" * 30_000 + "+1" + " " * 30_000), (2005, "\U0001f600 1.2.3.4 é a@b.cd " * 3000)]
    got = base(docs_of(rows))
    for i, t in rows:
        assert got[i] == plain(t), (i, t and t[:300])


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = pii.op13_pii(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        want = plain(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[3] == k for x in want) for k in PLAIN]
        line = ",".join(f"{k}:{a}:{b}" for a, _, b, k in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(r.spans.split(",")) or not line
        assert r.n_added == 0  # the tables hold no other forms; numbers that fail the card test are none


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 4097])
def test_running(spark, n):
    xs = [random.Random(n).randint(0, 50) for _ in range(n)]
    (got,) = spark.createDataFrame([(xs,)], "a array<int>").select(pii.running(F.col("a"))).first()
    want, at = [], 0
    for x in xs:
        want.append(at)
        at += x
    assert got == want


def supervised(prose):
    rng = random.Random(1)
    given, rest = ["Maria", "Peter", "Sarah", "Pablo", "Elena", "Martin"], ["Lopez", "Keller", "Novak", "Moreau", "Smith"]
    rng_digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    rows, planted = [], {}
    for i in range(400):
        words, kind = prose(30, i), i % 8
        put = {
            0: ("name: ", "name", f"{rng.choice([*given[:4], 'Anna', 'Mark', 'Paul', 'Laura'])} {rng.choice(rest)}"),
            1: ("phone: ", "number", f"({rng_digits(3)}) {rng_digits(3)}-{rng_digits(4)}"),
            2: ("mail ", "handle", f"user{i} [at] host{i} [dot] com"),
            3: ("iban ", "iban", "DE89 3704 0044 0532 0130 00"),
            4: ("", None, f"{prose(1, i).title()} {prose(1, i + 1).title()}"),
            5: ("order no ", None, rng_digits(14)),
            6: ("mail me ", "email", f"u{i}@mail.example.com"),
            7: ("", None, ""),
        }[kind]
        text = f"{words} {put[0]}{put[2]} {words}"
        rows.append((i, text))
        if put[1]:
            start = len(words) + 1 + len(put[0])
            planted[i] = f"{put[1]}:{start}:{start + len(put[2])}"
    return rows, planted


def test_added_spans(docs_of, prose):
    """Votes that agree make spans; names without a gazetteer's word, and long numbers after an order's words, aren't."""
    rows, planted = supervised(prose)
    got = {r.doc_id: r for r in pii.find_personal(docs_of(rows)).select("doc_id", pii.listed(F.sort_array(F.concat("base", "added"))).alias("spans")).collect()}
    missed = [planted[i] for i in planted if planted[i] not in got[i].spans.split(",")]
    wrong = [s for i, _ in rows if i not in planted for s in got[i].spans.split(",") if s and not s.startswith("card:")]  # a number may pass the card test
    assert len(missed) <= 0.05 * len(planted), missed
    assert not wrong


def test_reliabilities():
    """EM finds which labelers are right from votes alone."""
    rng = random.Random(2)
    true = [0.95, 0.9, 0.85, 0.6, 0.8]
    counts = {}
    for _ in range(20_000):
        y = 1 if rng.random() < 0.3 else -1
        vote = tuple(0 if rng.random() < 0.2 else y if rng.random() < a else -y for a in true)
        counts[vote] = counts.get(vote, 0) + 1
    share, accuracy = pii.reliabilities([("number", v, n) for v, n in sorted(counts.items())])
    assert abs(share["number"] - 0.3) < 0.03
    assert all(abs(accuracy["number", i] - a) < 0.03 for i, a in enumerate(true))


def test_classifier_follows_posteriors():
    base_row = ("name", "none", "mid", "2", "space", "0", "1", "1", "0", "0")
    other = ("name", "none", "mid", "2", "space", "0", "-1", "0", "0", "0")
    weights, bias = pii.fit([(base_row, 0.95, 50), (other, 0.02, 900)])
    z = lambda r: bias + sum(weights[f, v] for f, v in zip(pii.FEATURES, r))
    assert z(base_row) > 1.5 and z(other) < -2.5
    assert pii.fit([]) == ({}, 0.0)


def test_native_and_empty(docs_of):
    frame = docs_of([])
    assert pii.find_personal(frame).count() == 0
    docs = docs_of([(1, "a@b.cd"), (1, "a@b.cd"), (None, "+1 (017) 555-7713"), (3, None)])
    out = pii.find_personal(docs)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    rows = sorted(map(str, out.collect()))
    assert len(rows) == 4 and rows.count(next(r for r in rows if "doc_id=1" in r)) == 2
