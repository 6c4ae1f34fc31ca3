import pytest

from docstyle import taxonomy


def test_each_metric_has_one_category_and_what_is_left_out_is_known():
    names = [m for x in taxonomy.CATEGORIES.values() for m in x]
    assert len(names) == len(set(names)) == len(taxonomy.CATEGORY)
    assert set(taxonomy.LEFT_OUT) <= set(names) and len(set(taxonomy.LEFT_OUT)) == len(taxonomy.LEFT_OUT)


def test_selection_keeps_the_order_and_rejects_unknown_names():
    assert list(taxonomy.select_features(["mattr", "id", "comma_rate", "n_chunks", "oov_ratio"], taxonomy.LEFT_OUT)) == ["mattr", "oov_ratio", "comma_rate"]
    assert taxonomy.select_features([]) == {}
    with pytest.raises(ValueError, match="matr"):
        taxonomy.select_features(["mattr"], ["matr"])


def test_features_and_table(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, 3.0)], "id string, comma_rate double, mattr double, lix double")
    assert taxonomy.features(df, ["id"]).columns == ["id", "mattr", "comma_rate"]
    assert taxonomy.table(spark).where("left_out").count() == len(taxonomy.LEFT_OUT)
