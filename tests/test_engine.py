"""The facade, and planned queries."""

import json

from pyspark.sql import functions as F

from quillstone.engine import Engine
from quillstone.operators import evidence as E


def test_ask(spark):
    chunks = spark.createDataFrame([("a", "china revenue", [1.0, 0.0], "D", 3), ("b", "operating cash", [0.0, 1.0], "D", None)], "chunk_id string, text string, embedding array<float>, document_id string, page int")
    q = spark.createDataFrame([("q1", "china", [1.0, 0.0]), ("q2", "cash", [0.0, 1.0]), ("q3", "zzz", None), ("q4", "revenue", [1.0, 0.0])], "query_id string, question string, qvec array<float>")
    says = lambda question, context: F.when(question == "china", F.concat(F.lit("Up [E1] and [E9]: "), F.substring(context, 1, 4))).when(question == "cash", "Down [E1].").otherwise("No idea.")
    got = {r.query_id: r for r in Engine(chunks, says, candidate_k=2, top_k=1).ask(q).collect()}
    assert len(got) == 4
    assert (got["q1"].status, got["q1"].labels, got["q1"].unknown) == ("invalid", ["E1"], ["E9"]) and "page 3" in got["q1"].context and got["q1"].answer.endswith("[E1]")
    assert (got["q2"].status, got["q2"].labels) == ("valid", ["E1"]) and "operating cash" in got["q2"].context
    assert (got["q3"].status, got["q3"].answer, got["q3"].context) == ("no_evidence", None, None) and got["q4"].status == "uncited"
    assert {r.chunk_id for r in Engine(chunks, says, candidate_k=2, top_k=1).retrieve(q.where("query_id = 'q1'"), spark.createDataFrame([("q1", "a")], "query_id string, chunk_id string")).collect()} == {"b"}


def test_planned_queries(spark):
    good = [" Net sales ", "net  SALES", "Margin"]
    replies = [json.dumps({"queries": good}), json.dumps({"queries": []}), json.dumps({"queries": ["a", 1]}), json.dumps({"queries": ["a"], "more": 1}), "no json", None, json.dumps({"queries": ["a", " "]}), json.dumps({"queries": ["x" * 4001]}), json.dumps({"queries": list("abcde")})]
    df = spark.createDataFrame([(i, f"Q{i}", r) for i, r in enumerate(replies)], "session int, question string, reply string")
    got = {r.session: (r.queries, r.fell_back) for r in E.planned_queries(df, 4).collect()}
    assert got[0] == (["Net sales", "Margin"], False) and all(got[i] == ([f"Q{i}"], True) for i in range(1, 9))
    assert E.planned_queries(df).where("session = 8").first().queries == list("abcde")
