"""Kept vectors are read only while they are newer than the reviews."""

import time

from candorlake.sources import files


def test_vectors_are_read_only_if_newer(spark, tmp_path):
    reviews, path = f"{tmp_path}/reviews", f"{tmp_path}/vectors"
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.5, 0.25])], "review_id string, embedding array<float>")
    assert files.read_vectors(spark, path, reviews) is None
    files.write_table(vectors.select("review_id"), reviews)
    time.sleep(0.05)
    files.write_vectors(vectors, path)
    assert sorted(files.read_vectors(spark, path, reviews).collect()) == sorted(vectors.collect())
    time.sleep(0.05)
    files.write_table(vectors.select("review_id"), reviews)
    assert files.read_vectors(spark, path, reviews) is None


def test_a_vector_is_not_compared_with_its_own_id(spark):
    """Whatever the order in which a block's two sides are gathered, and if an id repeats."""
    from candorlake.operators import semantic

    rows = [(1, "a", [1.0, 0.0]), (1, "a", [1.0, 0.0]), (2, "a", [0.0, 1.0]), (3, "a", None), (4, "b", [1.0, 1.0]), (4, "b", [1.0, 1.0])]
    got = semantic.most_similar(spark.createDataFrame(rows, "id long, g string, embedding array<float>"), "g", "id").collect()
    assert {r.id: r.mcs_score for r in got} == {1: 0.0, 2: 0.0, 3: 0.0, 4: 0.0} and len(got) == 4
