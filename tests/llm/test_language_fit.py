from marquee.llm import language_id


def test_the_model_is_fitted_in_a_task(spark, monkeypatch):
    """Fitting held the sample's words and gradients in the driver."""

    def never(*_):
        raise AssertionError("fitted on the driver")

    monkeypatch.setattr(language_id, "train", never)  # tasks import their own
    rows = [(i, "one two three of the words" if i % 2 else "eins zwei drei von den Worten", "en" if i % 2 else "de") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(docs)
    assert model.labels == ["de", "en"]
    assert all(r.lang_pred == rows[r.doc_id][2] for r in language_id.predict(docs, model).collect())
