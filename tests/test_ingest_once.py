"""The ingest flow reads and redacts each document once, however many steps take its records."""

from pyspark.sql import functions as F

from factmill.plans import flows


def test_each_document_is_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(text):
        seen.add(1)
        return text

    docs = spark.createDataFrame([(i, "Diagnosis: asthma. Takes Warfarin 5 mg and ibuprofen 400 mg daily.") for i in range(20)], "doc_id long, text string")
    drugs = spark.createDataFrame([("aspirin", 1)], "drug string, n long")
    got = flows.ingest(spark, docs.select("doc_id", read("text").alias("text")), drugs).collect()
    assert {r["doc_id"] for r in got} == set(range(20))
    assert seen.value == 20
