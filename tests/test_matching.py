"""Matching of line items against brute force, over every document."""

from paperloom import plans
from paperloom.operators import matching as M

from .conftest import SF

ITEM = "doc_id long, row_index int, description string, reference string, quantity double, unit_price double, line_total_ht double"


def brute(predicted, truth, least=0.62):
    """Takes the best remaining pair of a document again and again."""
    out = []
    for doc in {x["doc_id"] for x in predicted + truth}:
        a, b = ([x for x in side if x["doc_id"] == doc] for side in (predicted, truth))
        while pairs := [(M.match_score(x, y), x["row_index"], y["row_index"]) for x in a for y in b]:
            s, i, j = max(pairs)
            if s < least:
                break
            out.append((doc, i, j, round(s, 6)))
            a, b = [x for x in a if x["row_index"] != i], [y for y in b if y["row_index"] != j]
        out += [(doc, x["row_index"], None, None) for x in a] + [(doc, None, y["row_index"], None) for y in b]
    return out


def test_match_items(spark):
    rows = [
        [(1, 1, "blue pen", "A", 1.0, 2.0, 2.0), (1, 2, None, "B", None, 3.0, 6.0), (1, 3, "red ink", "C", 1.0, 9.0, 9.0), (2, 1, None, None, None, None, None), (3, 1, "nan", None, 1.0, 1.0, 1.0), (None, 1, "x y", "X", 1.0, 1.0, 1.0)],
        [(1, 7, "blue pen", "A", 2.0, 2.0, 4.0), (1, 8, "blue pen", "A", 1.0, 2.0, 2.0), (1, 9, None, "B", None, 3.0, 6.0), (3, 1, None, None, 1.0, 1.0, 1.0), (4, 1, "only truth", "T", 1.0, 1.0, 1.0), (None, 2, "x y", "X", 1.0, 1.0, 1.0)],
    ]
    sides = [spark.createDataFrame(r, ITEM) for r in rows]
    got = sorted(map(tuple, M.match_items(*sides).collect()), key=str)
    assert got == sorted(brute(*[[r.asDict() for r in x.collect()] for x in sides]), key=str)
    assert (1, 1, 8, 1.0) in got and (None, 1, 2, 1.0) in got and (4, None, 1, None) in got and (2, 1, None, None) in got
    assert M.match_items(sides[0].where("doc_id > 9"), sides[1].where("doc_id > 9")).count() == 0


def test_all_items_are_matched(spark, monkeypatch):
    seen = []
    whole = M.match_items
    monkeypatch.setattr(M, "match_items", lambda p, t: seen.append((p, t)) or whole(p, t))
    got = sorted(map(tuple, plans.QUERIES["jon22_match_all_items"](spark, SF).collect()), key=str)
    predicted, truth = ([{k: float(v) if k in ("quantity", "unit_price", "line_total_ht") and v is not None else v for k, v in r.asDict().items()} for r in x.collect()] for x in seen[0])
    assert got == sorted(brute(predicted, truth), key=str)
    items = {(d, i) for d, i, _, _ in got if i is not None}
    assert items == {(x["doc_id"], x["row_index"]) for x in predicted} and any(d % 50 for d, _ in items)
    assert any(x["description"] is None for x in predicted) and any(x["quantity"] is None for x in predicted)
    assert any(j is None for _, _, j, _ in got) and any(i is None for _, i, _, _ in got)
