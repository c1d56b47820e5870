import random

from flowlake.llm import language_id as li

WORDS = "a the of and to in is was for with that from this have not are".split()


def test_short_clean_rows_stay(spark):
    rng = random.Random(4)
    long_ = [(i, " ".join(rng.choice(WORDS) for _ in range(120)), "en") for i in range(400)]
    short = [(1000, "A.", "en"), (1001, "a", "en"), (1002, "is", "en"), (1003, "To.", "en"), (1004, "a of", "en"), (1005, "I", None)]
    junk = [(2000, "漢", None), (2001, "漢字漢字", None), (2002, "ß", None), (2003, "z", None), (2004, "zqzq", None), (2005, "...", "en"), (2006, None, "en")]
    df = spark.createDataFrame(long_ + short + junk, "doc_id long, text string, lang string")
    model = li.Model(train := li.training_texts(df), li.byte_classes([t for x in train.values() for t in x]))
    assert model.bits[0] > 2 * li.MAX_BITS  # one phrase of two symbols is over the limit
    kept = {r["doc_id"] for r in li.keep_known(df).collect()}
    assert kept == {r[0] for r in long_ + short}


def test_phrases_beyond_the_first():
    train = ["the cat sat on the mat and the dog"]
    model = li.Model({"a": train}, li.byte_classes(train))
    whole, more = model.rates(["the cat", "t", "z", "tz", None])
    b = model.bits[0]
    assert (whole == model.bits_per_symbol(["the cat", "t", "z", "tz", None])).all()
    assert [round(x / b, 6) for x in more[:, 0]] == [0, 0, 1, 0.5, 0]
