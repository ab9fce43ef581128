"""Columns whose work must follow the length of a text, not its square."""

import time

from factmill.functions import annotate as A
from factmill.functions import text as T


def test_line_faults_of_many_lines(spark):
    lines = ["word " * 4] * 6000 + ["x" * 300, "", "", "", "", ""]
    df = spark.createDataFrame([("\n".join(lines),), ("a\nb",), ("\n\n\n\n",), (None,)], "text string")
    began = time.time()
    assert [r[0] for r in df.coalesce(1).select(T.line_faults(df["text"])).collect()] == [2, 0, 0, None]
    assert time.time() - began < 20


def test_sentence_of_an_entity_in_a_long_text(spark):
    text = "a " * 100_000 + ". No asthma at all! Mother had a cough"
    df = spark.createDataFrame([("asthma", text), ("cough", text)], "entity string, text string").coalesce(1)
    began = time.time()
    got = {r["entity"]: r["annotation"] for r in A.annotate(df).collect()}
    assert time.time() - began < 20
    assert (got["asthma"]["negation_type"], got["asthma"]["subject"], got["cough"]["subject"]) == ("absent", "patient", "mother")
