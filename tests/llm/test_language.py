from __future__ import annotations

import random
import zlib

from tidemark.llm.language import WORD, LanguageLabeller, LanguageModel, _count_labelled, label_language, segment_text, sentences

SCHEMA = "fetch_no long, body string, lang string, code string, segment int"
PARTS = {
    "en": (["the baker", "our house", "a small boat", "the old town"], ["shows", "keeps", "finds", "opens"], ["the window with care", "a letter for the school", "every street in the morning"]),
    "de": (["der Bäcker", "unser Haus", "ein kleines Boot", "die alte Stadt"], ["zeigt", "behält", "findet", "öffnet"], ["das Fenster mit Sorgfalt", "einen Brief für die Schule", "jede Straße am Morgen"]),
    "fr": (["le boulanger", "notre maison", "un petit bateau", "la vieille ville"], ["montre", "garde", "trouve", "ouvre"], ["la fenêtre avec soin", "une lettre pour l'école", "chaque rue le matin"]),
}


def sentence(rng, code):
    return " ".join(rng.choice(p) for p in PARTS[code]).capitalize() + "."


def corpus(seed=7):
    rng = random.Random(seed)
    rows = []
    for k in range(240):
        code = rng.choice(list(PARTS))
        label = {"en": "en-GB", "de": "Deutsch", "fr": "FRA"}[code] if rng.random() < 0.75 else rng.choice(["en", "de", None, "und"])
        rows.append((k, "\n\n".join(" ".join(sentence(rng, code) for _ in range(3)) for _ in range(3)), label, code, 1))
    return rng, rows


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in ("en-GB", " EN ", "German", "pt_BR", "Español", "und", "", None, "unknown", "nld")], "x string")
    assert [r[0] for r in df.select(label_language(df["x"])).collect()] == ["en", "en", "de", "pt", "es", None, None, None, None, "nl"]


def test_sentences():
    found = sentences("A heading\r\nFirst {{x}} one is here now. Second costs 3.5 units today!\n\nshort.")
    assert [(n, w) for n, _, w in found] == [(0, False), (1, True), (1, True), (3, False)]
    assert sentences(None) == [] and sentences("") == []


def test_missing_labels(spark):
    rng, rows = corpus()
    mixed = " ".join(sentence(rng, "fr") for _ in range(3)) + "\n" + " ".join(sentence(rng, "de") for _ in range(3))
    extra = [(900, mixed, "fr", "x", 1), (901, None, "en", "x", 1), (902, "", None, "x", 1), (903, " ".join(sentence(rng, "fr") for _ in range(3)) + " " + sentence(rng, "de"), "fr", "x", 1),
             (904, "Lorem ipsum dolor sit amet elit. Sed do eiusmod tempor incididunt labore. Ut enim ad minim veniam quis.", None, "x", 1),
             (905, " ".join(sentence(rng, "en") for _ in range(5000)), "de", "x", 1), (None, mixed, None, "x", 1), rows[0]]
    df = spark.createDataFrame(rows + extra, SCHEMA)
    found = {tuple(r) for r in LanguageLabeller().missing(df).collect()}
    codes = {"en-GB": "en", "Deutsch": "de", "FRA": "fr"}
    true = {(k, code) for k, _, label, code, _ in rows if codes.get(label, label) != code}
    assert found == true | {(900, "de"), (905, "en")}
    labels = {r["fetch_no"]: r for r in LanguageLabeller().labels(df).collect()}
    assert sum(labels[k]["lang"] == code for k, _, _, code, _ in rows) == len(rows)
    assert labels[901]["lang"] is None and labels[901]["confidence"] == 0.0 and labels[904]["lang"] is None
    assert len(labels) == len(rows) + 6


def test_unseen_words_back_off():
    model = LanguageModel({"en": {"the": 9.0, "showing": 3.0, "finding": 2.0}, "de": {"der": 9.0, "zeigung": 3.0, "findung": 2.0}}, ["en", "de"])
    assert model.score("making the hopping")[0] == "en" and model.score("der Schreibung")[0] == "de"
    assert model.score("")[0] is None and segment_text(model, None, 0.8) == []


def test_backoff_on_held_out_documents(spark):
    """Half of all words are kept from a model; they tell the language of held-out documents' sentences by their n-grams alone."""
    docs = spark.read.parquet("/root/testdata/sf0.01/crawled_docs.parquet").select("fetch_no", "body", "lang")
    labeller, held_out = LanguageLabeller(), lambda word: zlib.crc32(word.encode()) % 2 == 0
    code = label_language(docs["lang"]).alias("code")
    seen = docs.where("fetch_no % 2 = 0").select(code, docs["body"].alias("text")).where("code is not null and text is not null")
    counts = labeller._counts(seen.mapInPandas(_count_labelled, "code string, word string, n double"))
    full = LanguageModel(counts, list(counts))
    half = LanguageModel({c: {w: n for w, n in words.items() if not held_out(w)} for c, words in counts.items()}, list(counts))
    common = {w for words in counts.values() for w, n in words.items() if n >= 5}  # invented names are of no language
    right = total = 0
    for row in docs.where("fetch_no % 2 = 1").collect():
        for _, text, whole in sentences(row["body"]):
            unseen = [w for w in WORD.findall(text.lower()) if held_out(w) and w in common]
            lang, sure, _ = full.score(text)
            if whole and len(unseen) >= 4 and sure > 0.99:
                total += 1
                right += half.score(" ".join(unseen))[0] == lang
    assert total > 200 and right / total > 0.7, (right, total)


def test_sample_bounds_the_fit_only(spark):
    rng, rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    small = {tuple(r) for r in LanguageLabeller(sample=20).missing(df).collect()}
    assert small == {tuple(r) for r in LanguageLabeller().missing(df).collect()}


def test_no_rows(spark):
    assert LanguageLabeller().missing(spark.createDataFrame([], SCHEMA)).count() == 0
