import hashlib
import re

from corpus import SF, docs  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st

from starmill.llm import pii
from starmill.llm.queries import QUERIES

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def brute(text):
    """Base spans by plain searches over the whole text."""
    found = [(m.start(), "email", m.end()) for m in EMAIL.finditer(text)]
    for m in pii.ADDRESS.finditer(text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            found.append((m.start(), "ip", m.end()))
    for m in pii.CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), "card", m.end()))
    for m in pii.PHONE.finditer(text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found.append((m.start(), "phone", m.end()))
    return sorted(found, key=lambda s: (s[0], pii.RANK[s[1]]))


def base(text):
    return [s for s in pii.find_spans(text) if s[1] in pii.BASE]


pieces = st.sampled_from(
    ["a", "b.c", "@", "@@", ".", "..", "-", "+", "+1", " ", "1", "12", "255", "256", "001", "0",
     "4111111111111111", "4111 1111 1111 1111", "4111-1111", "(030)", "x@y.zz", "é", "\n", "://",
     "1.2.3.4", "+49 30 1234567", "user:pw@", "token = abcdefghijklmnop1"]
)


@settings(max_examples=1500, deadline=None)
@given(st.lists(pieces, max_size=14))
def test_base_spans_equal_plain_searches(parts):
    text = "".join(parts)
    assert base(text) == brute(text)


def test_added_kinds():
    text = (
        "see https://bob:s3cret@host.example/x and token = \"24be64439e3e49cf46b2\" or IBAN "
        "DE89 3704 0044 0532 0130 00, account no 12345678, at 12 Long Hill Street."
    )
    kinds = {k: text[s:e] for s, k, e in pii.find_spans(text)}
    assert kinds["login"] == "bob:s3cret"
    assert kinds["secret"] == "24be64439e3e49cf46b2"
    assert "12 Long Hill Street" == kinds["street"]
    accounts = [text[s:e] for s, k, e in pii.find_spans(text) if k == "account"]
    assert accounts == ["DE89 3704 0044 0532 0130 00", "12345678"]


def test_whole_table_matches_plain_searches(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    seen = 0
    for row in QUERIES["op4_pii"](spark, SF).collect():
        spans = brute(texts[row.doc_id])
        kinds = [k for _, k, _ in spans]
        assert [row[f"n_{k}"] for k in pii.BASE] == [kinds.count(k) for k in pii.BASE]
        joined = ",".join(f"{k}:{s}:{e}" for s, k, e in spans)
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        seen += len(spans)
    assert seen > 0


def test_edges(docs):
    empty = hashlib.sha256(b"").hexdigest()
    long = "x " * 200_000 + "me@site.org"
    zeros = "0" * 6000 + "1.2.3.4 " + "9" * 6000 + ".1.1.1"
    assert [(k, e) for _, k, e in pii.find_spans(zeros)] == [("ip", 6007)]
    rows = pii.find_personal_data(docs([None, "", long, long])).orderBy("doc_id").collect()
    assert [(r.base_sha256 == empty, r.spans) for r in rows[:2]] == [(True, ""), (True, "")]
    assert rows[2].spans == rows[3].spans == "email:400000:400011"
    assert pii.find_personal_data(docs([])).count() == 0


def test_redact(docs):
    frame = docs([None, "mail a@b.cd, +49 30 12345678 and 1.2.3.4!", "clean"])
    frame = frame.withColumnRenamed("lang", "_clean")
    rows = pii.redact(frame).orderBy("doc_id").collect()
    assert rows[0].text is None
    assert rows[1].text == "mail <EMAIL>, <PHONE> and <IP>!" and rows[1].n_chars == len(rows[1].text)
    assert rows[2].text == "clean" and pii.redact(frame).columns == frame.columns
