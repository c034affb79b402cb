"""Winners are found in one pass over the lines, from safe lines alone."""

from paperloom.functions.predicates import with_predicates
from paperloom.operators import parties
from paperloom.operators.statements import Statement

from .test_statements import lines, named


def test_winners_read_lines_once_and_equal_the_rule(spark):
    texts = ["Acme Trading LLC", "Bill To", "Blue Ocean Inc", "Tax ID: 99", "contact@shop.com", "acme trading llc", "Total Due", "Service plan", "Société Delta SARL", "Client", "Nord Medical Group"]
    rows = with_predicates(lines(spark, *[(t, 40 + 420 * (k % 2), 40 + 22 * k) for k, t in enumerate(texts)]))
    rows = rows.drop("doc_id").crossJoin(spark.range(6).withColumnRenamed("id", "doc_id")).where("(line_index + doc_id) % 4 <> 0 or doc_id = 5")
    found = named(parties, "pty03_winners")(lines=rows)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate inline") == 1 and "Join FullOuter" not in plan
    rule = next(s for s in parties.STATEMENTS if s.name == "pty03_winners")
    want = Statement("as_written", "", rule.sql)(lines=rows).collect()
    assert sorted(map(str, found.collect())) == sorted(map(str, want)) and len(want) > 1
