"""Training gives the driver's memory back."""

from rollforge.llm import toxicity


def test_training_gives_its_memory_back(spark, monkeypatch):
    given = []
    monkeypatch.setattr(toxicity, "give_back", lambda: given.append(1), raising=False)
    docs = spark.createDataFrame([(i, f"word{i} " * 5) for i in range(8)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, toxic int")
    toxicity.train(docs, labels)
    assert given
