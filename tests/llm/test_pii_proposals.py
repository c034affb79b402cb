"""Proposals before punctuation and in other groups."""

from paperloom.llm import pii

from .test_operators import documents


def test_pii_proposals(spark):
    texts = ["Call 212-555-0199.", "call (212)555-0199, please", "phone: 1-212-555-0199.", "tel: 01 23 45 67 89.", "phone: 020 7946 0958", "server 10[.]0[.]0[.]7."]
    rest = ["order 123.456.7890", "version 212-555-0199-4471"]
    rows = pii.pii_report(documents(spark, texts + rest)).orderBy("doc_id").collect()
    assert [r["spans"].split(":")[0] for r in rows] == ["phone"] * 5 + ["ip"] + [""] * 2
    assert pii.redact(documents(spark, texts[:1])).first()["text"] == "Call [PHONE]."
