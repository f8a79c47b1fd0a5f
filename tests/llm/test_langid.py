import numpy as np

from prosegauge.llm import langid

DOCS = "doc_id long, text string, lang string"
ENGLISH = "the quick brown fox jumps over the lazy dog and then sleeps in the shade of a tree "
GERMAN = "der schnelle braune fuchs springt über den faulen hund und schläft dann im schatten "


def rows():
    made = [(i, (ENGLISH if i % 2 else GERMAN)[i % 7 :] * (1 + i % 3), "en" if i % 2 else "de") for i in range(60)]
    return [*made, (100, None, "en"), (101, "", "en"), (102, "12 34 !!", None), (None, ENGLISH, None), (103, ENGLISH * 2000, None), (1, ENGLISH, "en")]


def test_predictions_and_edges(spark):
    docs = spark.createDataFrame(rows(), DOCS)
    found = {}
    for r in langid.predict(docs).collect():
        found.setdefault(r.doc_id, r)
        assert 0 <= r.score <= 1
    assert all(found[i].lang_pred == ("en" if i % 2 else "de") for i in range(60))
    assert [found[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3
    assert found[103].lang_pred == found[None].lang_pred == "en" and found[None].held_out is False


def test_nothing_to_learn_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some text", None)], DOCS)
    assert langid.predict(docs).first().lang_pred == "und"
    assert langid.predict(spark.createDataFrame([], DOCS)).count() == 0


def test_keep_known_keeps_columns_and_clean_rows(spark):
    docs = spark.createDataFrame(rows(), DOCS).selectExpr("*", "1 as score", "2 as `found`", "3 as `language found x`")
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(rows()) - 3


def test_filter_answers_for_all_languages_with_corrected_counts():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 1 << 62, 5000)
    for n, width in ((3, 8), (20, 32), (70, 64)):
        word, bit = np.divmod(np.arange(5000) % n, width)
        masks = np.zeros((5000, -(-n // width)), f"uint{width}")
        masks[np.arange(5000), word] = np.left_shift(np.array(1, masks.dtype), bit.astype(masks.dtype))
        model = langid.LanguageFilter([str(i) for i in range(n)], masks, codes)
        found = model.languages_of(codes)
        assert ((found & masks) == masks).all()
        others = model._totals(model.languages_of(rng.integers(0, 1 << 62, 20_000)))
        assert np.abs(others - 20_000 * model.false_rate).max() <= 40 + 4 * np.sqrt(20_000 * model.false_rate).max()


def test_ngrams_do_not_depend_on_blocks(monkeypatch):
    text = "Ünïcode, words; and 12 numbers\n" * 50
    whole = np.concatenate(list(langid.ngrams(text)))
    monkeypatch.setattr(langid, "BLOCK", 7)
    assert (np.concatenate(list(langid.ngrams(text))) == whole).all()
