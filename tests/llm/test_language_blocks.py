import random

from tessera.llm import language


def test_long_texts_are_judged_by_all_of_them(spark):
    r = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz"
    shared = ["".join(r.choice(letters) for _ in range(r.randint(2, 9))) for _ in range(3000)]
    own = {k: ["".join(r.choice(letters) for _ in range(r.randint(3, 9))) for _ in range(1500)] for k in ("xx", "yy")}

    def text(k, n):
        return " ".join(r.choice(own[k] if r.random() < 0.3 else shared) for _ in range(n))

    model = [(k, language.plain(text(k, 16_000))[-language.BYTES :]) for k in own]
    rows = [(0, text("xx", 1000)), (1, text("xx", 150_000)), (2, text("yy", 150_000)), (3, text("xx", 60_000) + " " + text("yy", 500_000))]
    got = {x.doc_id: x for x in language.predict(spark.createDataFrame(rows, "doc_id int, text string"), model).collect()}
    assert [got[i].lang_pred for i in range(4)] == ["xx", "xx", "yy", "yy"]
    assert not any(got[i].rejected for i in range(4)) and got[1].score > 0.7 * got[0].score
