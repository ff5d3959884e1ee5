"""Subjects of hand-made texts in four languages, shared terms, mentions in passing, defined cases."""

from quarrystone.llm.subjects import Matcher, agreement, assigned, composition, scores, sentences, subject_scores

M = Matcher()


def of(text):
    return {s for s, x in scores(text, M, {})[1].items() if x >= 0.3}


def test_languages_and_shared_terms():
    assert of("The groundwater was tested. Costs of the wetland rose. The agreement is void.") == {"environment"}
    assert of("Der Betrag für Darlehen stieg auf 5 EUR. Die Parteien stritten über Tilgung, nicht über Einlage.") == {"banking"}
    assert of("Faute de preuve sur prescription, Art. 4 demeure applicable. Le montant lié à jugement atteint 3 EUR.") == {"litigation"}
    assert of("The prescription was handed over to Arko Ltd. The pharmacy is open to the public.") == {"healthcare"}
    assert of("Sin prueba sobre hipoteca, queda vigente Art. 4. El importe por aval subió hasta 5 EUR.") == {"banking"}
    assert of("The logo was handed over. The referee and the logo remain. The squad left the field.") == {"sport"}
    assert of("The bonus is due to the club. The appeal was heard by the panel.") == {"sport"}


def test_shares():
    text = "The lender agreed to the plan. " * 3 + "The circular is complete and final. " * 7
    assert scores(text, M, {}) == (10, {"banking": 0.3}) and of(text) == {"banking"}
    assert of("The lender agreed to it. " + "The circular is complete. " * 3) == set()
    assert of('The resolution quotes "a lender" in passing.') == set()
    assert of("") == of("   \n") == of("!!! ??? 123") == set() and scores(None, M, {}) == (0, {})
    assert len(sentences("One is here. Two is there, e.g. in Art. 4. Three?")) == 2


def test_on_spark(spark):
    rows = [(1, "The lender paid it. The overdraft is gone.", "xx"), (2, None, "en"), (3, "", "en"), (4, "The patch is out. The tenant left it.", None), (4, "The patch is out. The tenant left it.", None), (None, "The lender paid it.", "en"), (5, "word " * 60_000, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, subject string")
    s = subject_scores(df)
    got = sorted((r.doc_id, r.subject) for r in assigned(s).collect())
    assert got == [(1, "banking"), (4, "real_estate"), (4, "software")]
    assert {r.subject: r.n_docs for r in composition(s).collect()} == {"banking": 1, "real_estate": 1, "software": 1, None: 3}
    labels = spark.createDataFrame([(1, " Banking"), (4, "Real Estate"), (4, "sport"), (None, "sport"), (2, None)], "doc_id long, subject string")
    assert {(r.subject, r.n_labels, r.n_assigned) for r in agreement(assigned(s), labels).collect()} == {("banking", 1, 1), ("real_estate", 1, 1), ("sport", 1, 0)}
    assert subject_scores(df.limit(0)).count() == 0
