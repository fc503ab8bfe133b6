from pyspark.sql import functions as F

from corpuscle.operators import semantic
from corpuscle.operators.kept import stored


def test_lists_meet_their_norms_without_a_join(spark):
    """Weights are those of unit vectors; a document's rows are joined with its idf only, and lists are kept as Parquet."""
    docs = spark.createDataFrame([(1, "a b b"), (2, "a"), (3, "c c c d"), (4, None)], "id long, text string")
    made = []

    def keep(df):
        made.append(df._jdf.queryExecution().optimizedPlan().toString())
        return stored(df)

    lists = semantic.semantic_lists(docs, F.split("text", " "), keep)
    assert made[-1].count("Join") == 1 and lists.lists.inputFiles()[0].endswith(".parquet")
    norms = {r.id: r.norm for r in lists.lists.groupBy("id").agg(F.sum(F.col("weight") * F.col("weight")).alias("norm")).collect()}
    assert norms.keys() == {1, 2, 3} and all(abs(n - 1) < 1e-12 for n in norms.values())
    assert [r.id for r in lists.search(["d"], 0.1).collect()] == [3]
