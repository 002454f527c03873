import pytest

from folioflow.llm.pairs import TARGETS, defects, is_copy, languages, looked_at, natural

ORIGINAL = "The storage tank fills the signal cable before the next inspection. Never open the valve with the supplied tool!"
GOOD = "Der Vorratsbehälter füllt das Signalkabel vor der nächsten Inspektion. Öffnen Sie das Ventil niemals mit dem Werkzeug!"




def defect(original, proposal, target):
    """What the pair alone shows, and the language; not what the statistics of all pairs show."""
    shown, wrong, *_ = looked_at(original, proposal)
    return shown or ("wrong_language" if target in TARGETS and wrong >> TARGETS.index(target) & 1 else None)


@pytest.mark.parametrize(
    "proposal, want",
    [
        (GOOD, None), (GOOD + "\n", None), (None, "empty"), ("", "empty"), (" \n\u200b\ufeff", "empty"), ("…", "empty"), ("[no output]", "empty"), ("(kein Text)", "empty"), ("n/a", "empty"), ("<br>", "empty"),
        (ORIGINAL, "copied"), (ORIGINAL.upper(), "copied"), ("Übersetzung: " + ORIGINAL.replace("tank", "tonk"), "copied"), (ORIGINAL + " " + GOOD, "copied"), (ORIGINAL.replace(" ", "  "), "copied"),
        ("I'm sorry, but I can't translate this passage.", "refusal"), ("Als Sprachmodell kann ich diesen Text nicht übersetzen.", "refusal"), ("Dieser Inhalt liegt außerhalb dessen, wobei ich unterstütze.", "refusal"), ("That is something I would rather not render.", "refusal"),
        ("La soupape ne donne aucun signal pendant la nuit et le module de contrôle arrête la ligne du côté gauche.", "wrong_language"), ("Новый насос не подаёт сигнал ночью.", "wrong_language"), ("De vloersensor stopt de lijn meteen gedurende de nacht en het ventiel opent het luik met de hand.", "wrong_language"),
    ],
)
def test_defects(proposal, want):
    assert defect(ORIGINAL, proposal, "de") == want


def test_what_is_no_defect():
    assert defect("PN99.123", "PN99.123", "de") is None
    assert defect("Ø 21 × 496", "Ø 21 × 496", "de") is None
    assert defect("x" * 200, "x" * 200, "de") is None
    assert defect("The desk of Linick must decline requests for the tank.", "Die Stelle in Linick muss Anfragen für den Tank ablehnen.", "de") is None
    assert defect("I cannot translate this text.", "Ich kann diesen Text nicht übersetzen.", "de") is None
    assert defect("Seal ring once per quarter", "Dichtring einmal pro Quartal", "de") is None
    assert defect(ORIGINAL, GOOD, None) is None and defect(None, "Hallo", "de") is None


def test_wordless_originals_and_empty():
    assert defect("104-214-959", "—", "de") == "empty" and defect(None, None, None) == "empty"
    assert [natural(t) for t in ("PN99.123", "TK 228.686", "5 mm", "25 bar", "one", "DIN-R 326", "THE TANK RAN", "", "7bcecac6fd6e59c8", "漢字の文")] == [False, False, False, False, True, False, True, False, False, True]


def test_languages_and_long_texts():
    votes = languages("the tank and the pump of the plant".split())
    assert max(votes, key=votes.get) == "en" and languages([]) == {}
    long = ORIGINAL * 3_000
    assert is_copy(long, long + " more") and defect(long, GOOD * 3_000, "de") is None


def test_truncated(spark):
    """The model learns from all pairs, of which nearly all are whole."""
    whole = [(k, "j", str(k), ORIGINAL + " More of it." * (k % 3), GOOD + " Mehr davon." * (k % 3) + "!" * (k % 2)) for k in range(400)]
    cut = [(1_000, "j", "a", ORIGINAL, "Der Vorratsbehälter füllt das"), (1_001, "j", "b", ORIGINAL, "Der Vorratsbehälter füllt das Signalkabel vor…"), (1_002, "j", "c", ORIGINAL, GOOD[:70])]
    blocks = spark.createDataFrame(whole + cut, "block_key long, job_id string, id string, original string, proposal string")
    jobs, issues = spark.createDataFrame([("j", "de")], "job_id string, target_lang string"), spark.createDataFrame([], "job_id string, id string")
    assert {(r.block_key, r.defect) for r in defects(blocks, jobs, issues).collect()} == {(k, "truncated") for k in (1_000, 1_001, 1_002)}
    assert {(r.block_key, r.defect) for r in defects(blocks, jobs.where("false"), issues).collect()} == {(k, "truncated") for k in (1_000, 1_001, 1_002)}


def test_rows(spark):
    blocks = spark.createDataFrame(
        [(1, "j", "1", ORIGINAL, ORIGINAL, 0), (1, "j", "1", ORIGINAL, ORIGINAL, 1), (2, "j", "2", ORIGINAL, ORIGINAL, 0), (3, "j", "3", ORIGINAL, GOOD, 0), (4, "none", "4", ORIGINAL, None, 0), (5, None, None, ORIGINAL, ORIGINAL, 0), (6, "j", "6", None, None, 0)],
        "block_key long, job_id string, id string, original string, proposal string, kept int",
    )
    jobs = spark.createDataFrame([("j", "de"), ("j", "de"), ("k", None), (None, "en")], "job_id string, target_lang string")
    issues = spark.createDataFrame([("j", "2"), ("j", "2"), (None, None)], "job_id string, id string")
    got = sorted((r.block_key, r.defect) for r in defects(blocks, jobs, issues).collect())
    assert got == [(1, "copied"), (2, "retained"), (4, "empty"), (5, "copied"), (6, "empty")]
    assert defects(blocks.where("false"), jobs, issues).count() == 0
    assert defects(blocks, jobs.where("false"), issues.where("false")).where("defect = 'retained'").count() == 0
