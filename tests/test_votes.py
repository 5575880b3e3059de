from maskwright.operators import votes


def test_the_first_of_equal_options_wins(spark):
    rows = [
        (1, "serif", 1, 2), (1, "sans", 0, 1), (1, "sans", 5, 1), (2, "b", 3, 4), (2, "a", 3, 4), (3, "x", 0, None), (4, None, 0, 9), (5, "low", 0, -5), (5, "lower", 1, -6), (1, "mono", 2, None),
    ]
    scores = spark.createDataFrame(rows, "page int, option string, place int, score bigint")
    assert {tuple(r) for r in votes.winner(scores, ["page"]).collect()} == {(1, "sans", 2), (2, "a", 4), (3, "x", 0), (5, "low", -5)}
    assert votes.winner(scores.where("page > 9"), ["page"]).collect() == []
