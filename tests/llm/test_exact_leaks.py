from clickfeat.llm import decontaminate

NUMBERS = "add 12 34 56 78 90 11 22 33 44 55 66 77 88 99 10 20"


def test_exact_copies_of_number_heavy_and_short_items(spark):
    bench = spark.createDataFrame([(1, NUMBERS), (2, "capital of France"), (3, "7 plus 5 kg 3 m 9"), (4, "why")], "item_id long, text string")
    texts = [(1, "so " + NUMBERS.upper()), (2, "the Capital of France, they say"), (3, "7 plus 5 kg 3 m 9!"), (4, NUMBERS.replace("3", "4")), (5, "capital in France"), (6, "8 plus 5 kg 3 m 9"), (7, "Why?"), (8, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    out = {(r.doc_id, r.item_id): r.exact for r in decontaminate.contaminated(docs, bench).collect()}
    assert out == {(1, 1): True, (2, 2): True, (3, 3): True, (7, 4): True}
    assert {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()} == {4, 5, 6, 8}
