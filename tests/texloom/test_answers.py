"""Answers of services as Columns, against the plain functions."""

import json
import random

from pyspark.sql import functions as F

from texloom.functions import response, text


def test_reasoning_as_a_column(spark):
    rng = random.Random(3)
    parts = ["<think>", "</think>", "<Reasoning a='b'>", "</reasoning>", "<thinking>", "</thinking >", "a b", " ", "\n", "<p>", "<think", ">", "</analysis>", "<analysis>", "é"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(9))) for _ in range(600)] + [None, "", "<think>" * 9 + "</think>" * 9, "<think>" * 8 + "</think>" * 8 + "x", "a<think>b</think>c<analysis>d</analysis> "]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text.without_reasoning(F.col("t")).alias("r")).collect()
    got = {r["i"]: (r["r"]["value"], r["r"]["error"]) for r in rows}
    want = {i: (None, None) if t is None else response.strip_reasoning(t) for i, t in enumerate(texts)}
    assert got == want and sum(e is not None for _, e in want.values()) > 100


def test_reasons_of_slots(spark):
    slots = {"0": "words", "1": "more", "2": "  "}
    outputs = [
        ({"0": "a", "1": "b", "2": " "}, {"0": None, "1": None, "2": None}), ({"0": "a"}, {"0": None, "1": "missing", "2": "missing"}), ({"0": 5, "1": None, "2": ["x"]}, dict.fromkeys("012", "not_a_string")),
        ({"0": " \n", "1": "⟪P0000⟫", "2": "$x$"}, {"0": "empty_text", "1": "protected_token", "2": "invalid_syntax"}), ({"0": "<think>a", "1": "<think>a</think>b", "2": "\\x"}, {"0": "invalid_response_envelope", "1": None, "2": "invalid_syntax"}),
        ({"0": "<think>a</think> ", "1": "```", "2": ""}, {"0": "empty_text", "1": "invalid_syntax", "2": None}), ({"0": "a", "1": "b", "2": "c", "3": "d"}, None),
    ]
    rows = [(i, slots, json.dumps(o)) for i, (o, _) in enumerate(outputs)] + [(7, slots, "```json\n" + json.dumps(outputs[0][0]) + "\n```"), (8, slots, "[1]"), (9, slots, "{no"), (10, slots, None)]
    got = {r["i"]: r["r"] for r in spark.createDataFrame(rows, "i int, s map<string,string>, o string").select("i", text.slot_reasons(F.col("s"), F.col("o")).alias("r")).collect()}
    assert got == {i: w for i, (_, w) in enumerate(outputs)} | {7: outputs[0][1], 8: None, 9: None, 10: None}
