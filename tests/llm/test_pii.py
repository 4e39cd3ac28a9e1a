"""Account numbers among capitals and digits, against a search of every place and length."""

import hashlib
import random
import re
import time

import pytest

from earshot.llm import pii

IBANS = ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947", "FR14 2004 1010 0505 0001 3M02 606", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"]
AROUND = ["IBAN {}", "IBAN {} Thanks", "IBAN {} BIC COBADEFFXXX", "IBAN {} BIC, 5", "{} 42 then {}", "BE12 {} X", "\U0001f600 AT12 {}, {} ok {}", "iban {}X", "iban X{} 1"]
LENGTHS = {code: n for n, codes in pii.IBAN_LENGTHS.items() for code in codes.split()}


def brute_force(text: str) -> list[tuple[int, int]]:
    found = []
    for start in range(len(text)):
        for end in range(start + 15, min(len(text), start + 70) + 1):
            part, short = text[start:end], text[start:end].replace(" ", "")
            if not re.fullmatch("[A-Z]{2}[0-9]{2}( ?[A-Z0-9])+", part) or LENGTHS.get(short[:2]) != len(short):
                continue
            if re.match("[A-Za-z0-9]", text[start - 1 : start] or " ") or re.match("[A-Za-z0-9]", text[end:] or " "):
                continue
            if int("".join(str(int(c, 36)) for c in short[4:] + short[:4])) % 97 == 1:
                found.append((start, end))
    return found


@pytest.fixture(scope="module")
def docs(spark):
    texts = [around.replace("{}", iban) for around in AROUND for iban in IBANS] + ["", None, "DE89 3704 0044 0532 0130 01", "ZZ12 no"]
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_account_numbers_match_brute_force(docs):
    texts, df = docs
    got = {r.doc_id: [(x.start, x.end) for x in r.pii if x.kind == "iban"] for r in pii.find(df).collect()}
    assert got == {i: brute_force(t or "") for i, t in enumerate(texts)}
    assert all(got[i] for i in range(len(IBANS) * (len(AROUND) - 2)))


def test_account_numbers_are_redacted(spark):
    rows = pii.redact(spark.createDataFrame([(1, "IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX")], "doc_id long, text string")).collect()
    assert rows[0].text == "IBAN [IBAN] BIC COBADEFFXXX"


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits: str) -> bool:
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, str, int]]:
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if fine:
                out.append((m.start(), rank, kind, m.end()))
    return [(s, k, e) for s, _, k, e in sorted(out)]


def noise(rng: random.Random) -> str:
    parts = ["a.b@c.de", "x@y", "@", "1.2.3.4", "300.1.1.1", "0001.2.3.255.7", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 1234-5678", "+1", " ", "\n", "é", "\U0001f600", "tel", "9", "-", ".", "ssn 123-45-6789 ", "DE89370400440532013000", "word "]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))


def test_base_spans_match_the_stated_patterns(spark):
    rng = random.Random(7)
    texts = [noise(rng) for _ in range(1500)] + [None, "", "a@b.c " * 700, "1.2.3.4 +49 30 1234567 " * 300]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS pii", "'x' AS found")
    got = {r.doc_id: r for r in pii.digest(rows).collect()}
    for i, text in enumerate(texts):
        want = base_spans(text or "")
        joined = ",".join(f"{k}:{s}:{e}" for s, k, e in want)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), text
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(x[1] == k for x in want) for k in PATTERNS]
        assert set(joined.split(",")) <= set(got[i].spans.split(",")) | {""}


def test_redaction_replaces_merged_spans(spark):
    rng = random.Random(8)
    texts = [noise(rng) for _ in range(400)] + [None, "", "a@b.c, " * 400]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS pii", "2 AS start")
    found, redacted = pii.find(rows.drop("pii")).collect(), pii.redact(rows)
    assert redacted.columns == rows.columns
    got = {r.doc_id: r.text for r in redacted.collect()}
    for r in found:
        text, end, out = r.text or "", 0, ""
        for x in r.pii:
            if x.start >= end:
                out, end = out + text[end : x.start] + f"[{x.kind.upper()}]", x.end
            else:
                end = max(end, x.end)
        assert got[r.doc_id] == (None if r.text is None else out + text[end:])


def test_many_matches_take_linear_time(spark):
    took = []
    for n in (4000, 16000):
        rows = spark.createDataFrame([(1, "write to some.body@example.org, " * n)], "doc_id long, text string")
        start = time.perf_counter()
        row = pii.redact(rows).collect()[0]
        took.append(time.perf_counter() - start)
        assert row.text == "write to [EMAIL], " * n
        assert pii.digest(rows).collect()[0].n_email == n
    assert took[1] < 8 * took[0] + 5  # sixteen times would be quadratic


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pii.digest(none).collect() == [] == pii.redact(none).collect()
