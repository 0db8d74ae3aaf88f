from loanloom.operators import challengers


def test_codes_follow_the_sorted_labels(spark):
    words = [f"w{i:04d}" for i in range(700)]
    rows = [(i, w, ["x", None, "é", "A", ""][i % 5]) for i, w in enumerate(words * 3)]
    df = spark.createDataFrame(rows, "id int, word string, small string").repartition(5)
    out = challengers.label_encode(df, ["word", "small"])
    order = sorted({s for *_, s in rows if s is not None})
    got = out.collect()
    assert len(got) == len(rows) and out.columns == ["id", "word", "small", "word_code", "small_code"]
    assert all(r["word_code"] == int(r["word"][1:]) for r in got)
    assert all(r["small_code"] == (len(order) if r["small"] is None else order.index(r["small"])) for r in got)
    unseen = spark.createDataFrame([(1, "none", "x")], df.schema)
    assert challengers.label_encode(unseen, ["word"], challengers.label_dictionary(df, ["word"])).first()["word_code"] == 700
    assert challengers.label_encode(df.limit(0), ["word"]).collect() == []
