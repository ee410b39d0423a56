from quirework.llm import language_id as L


def test_rare_language_among_unlabelled_rows(spark):
    """A language with two labelled rows has a prototype, however many other rows there are."""
    en, de = "the quick brown fox jumps over the lazy dog", "der schnelle braune Fuchs springt über den Hund"
    rows = [(i, f"{en} {i}", "en" if i % 3 == 0 else None) for i in range(3000)] + [(5000 + i, f"{de} {i}", "de") for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    p = L.train(docs, L.Settings(train_rows=100))
    assert p.languages == ["de", "en"]
    assert {r.language for r in L.identify(docs.where("lang = 'de'"), p).collect()} == {"de"}
