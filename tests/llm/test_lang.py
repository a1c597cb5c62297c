from pathlib import Path

import pytest
from pyspark.sql import functions as F

from parlatrace.llm import lang_id
from parlatrace.llm.lang_model import Vocabulary, fit, fit_on_documents, sentences, stretches, words_of

DATA = Path("/root/testdata/sf0.01")
NAMES = {"english": "en", "german": "de", "en": "en", "de": "de", "eng": "en", "deu": "de", "ja": "ja"}


def test_sentences():
    text = "# 2025-01-01\n- One two. Three four?\n**S00** 00:12\nFive six\n[00:00:16] S01: Seven! Eight...\nS02 (00:22) Nine. 日本語です。はい。\n\n3\n00:00:01.000 --> 00:00:02.000\n<v S00>Ten\nWEBVTT\n12 34"
    assert [text[s.start : s.end] for s in sentences(text)] == ["One two.", "Three four?", "Five six", "Seven!", "Eight...", "Nine.", "日本語です。", "はい。", "Ten"]
    assert sentences("") == []


def test_words():
    assert words_of('Uh, they said "bonjour" twice. Mm') == ["they", "said", "twice"]
    assert words_of('"bonjour"') == ["bonjour"]
    assert words_of("12 34 …") == [] and words_of("日本語") == ["日本", "本語"]


@pytest.fixture(scope="module")
def samples(spark):
    if not DATA.exists():
        pytest.skip("no test tables here")
    rows = spark.read.parquet(str(DATA / "lang_samples.parquet")).orderBy("sample_id").collect()
    return [(r.code, r.text) for r in rows]


def test_held_out_samples(samples):
    train, test = [s for i, s in enumerate(samples) if i % 4], [s for i, s in enumerate(samples) if i % 4 == 0]
    model = fit(train)
    s = model.similarities([words_of(t) for _, t in test], Vocabulary())
    right = sum(model.languages[k] == lang for k, (lang, _) in zip(s.argmax(axis=1), test, strict=True))
    assert right >= 0.95 * len(test)
    assert ((model.confidence(s) > 0) & (model.confidence(s) <= 1)).all()


@pytest.fixture(scope="module")
def model(samples):
    return fit(samples)


def test_stretches(model):
    english, german, japanese = "Most of the visitors ask for the loading ramp two weeks ago.", "Ohne die Holzbrücke geht es auf dem Hof nicht weiter.", "作業場がないと温室の隣に仕事ができません。"
    text = f"- {english} {english}\n- {german}\n[00:01] S00: {japanese}{japanese}"
    got = stretches([text, "", None, "12 34", "uh, hmm.", english], model, Vocabulary())
    assert [(a, lang) for a, lang, _ in got[0]] == [(0, "en"), (text.index(german), "de"), (text.index(japanese), "ja")]
    assert got[1] == got[2] == got[3] == got[4] == [] and [(a, lang) for a, lang, _ in got[5]] == [(0, "en")]
    assert stretches([english.upper()], model, Vocabulary())[0][0][1] == "en"
    long = stretches([(english + " ") * 3000], model, Vocabulary())[0]
    assert len(long) == 1 and long[0][1] == "en"
    unknown = stretches(["Ωμέγα άλφα βήτα γάμμα δέλτα."], model, Vocabulary())[0]
    assert unknown[0][1] is None  # rejected: too far from every centroid


def test_wrong_labels_in_the_sample_do_no_harm(samples):
    good = [(lang, text + " " + text) for lang, text in samples] * 2
    wrong = [("de", text) for lang, text in samples if lang == "en"][:3]
    model = fit_on_documents(samples, good + wrong)
    s = model.similarities([words_of(t) for _, t in samples], Vocabulary())
    assert all(model.languages[k] == lang for k, (lang, _) in zip(s.argmax(axis=1), samples, strict=True))


LABELS = {"en": "en", " EN ": "en", "English": "en", "eng": "en", "en-GB": "en", "de_AT": "de", "auto": None, "?": None, "": None, None: None, "multilingual": None, "und": None}


def test_label_code(spark):
    df = spark.createDataFrame([(k,) for k in LABELS], "l string")
    assert [r[0] for r in df.select(lang_id.label_code(F.col("l"), NAMES)).collect()] == list(LABELS.values())


def test_operator(spark, rows, model):
    data = [(1, "Most of the visitors ask for the office.", "en"), (2, None, "en"), (3, "12", None), (1, "Most of the visitors ask for the office.", "en"), (None, "x", "en")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string").selectExpr("*", "1 as start_pos", "2 as _k", "3 as confidence")
    out = lang_id.language_stretches(df, model, carry={"label": F.col("lang")})
    assert rows(out, "doc_id", "label", "n_stretches", "start_pos", "lang") == [(1, "en", 1, 0, "en")] * 2
    assert lang_id.language_stretches(df.limit(0), model).count() == 0


def test_held_out_documents(spark, samples):
    """On documents whose label names a language and that weren't in the sample, text and label agree but for the share of wrong labels."""
    documents = spark.read.parquet(str(DATA / "documents.parquet"))
    names = lang_id.language_names(spark.read.parquet(str(DATA / "languages.parquet")))
    fitted = lang_id.fit_model(documents.where("doc_id % 2 = 0"), spark.read.parquet(str(DATA / "lang_samples.parquet")), names)
    held = documents.where("doc_id % 2 = 1")
    out = lang_id.language_stretches(held, fitted, carry={"label": lang_id.label_code(F.col("lang"), names)}).where("n_stretches = 1 and label is not null")
    n, right = out.selectExpr("count(*)", "count_if(label = lang)").first()
    assert n > 300 and right >= 0.9 * n


def test_a_change_in_the_midst_of_a_long_unit(samples):
    model = fit(samples)
    en, de = ([s.lower().strip(".!?").replace(",", "") for code, s in samples if code == c] for c in ("en", "de"))
    text = " ".join([*en[:3], de[0], *en[3:8]])  # in each half German is the lesser part
    got = stretches([text], model, Vocabulary())[0]
    assert [lang for _, lang, _ in got] == ["en", "de", "en"]
    assert [text[p:].startswith(w) for (p, _, _), w in zip(got[1:], (de[0].split()[0], en[3].split()[0]), strict=True)] == [True, True]
    assert [lang for _, lang, _ in stretches([" ".join(en[:8])], model, Vocabulary())[0]] == ["en"]


# Ordinary sentences on other matters than those of the tables: none is fitted on.
PLAIN = {

    "en": ["The weather is nice and we are going to the park.", "My grandmother bakes bread every weekend.", "He forgot his umbrella on the bus again.", "Nobody knows where the old letters are kept."],
    "de": ["Ich möchte heute in den Park gehen und ein Eis essen.", "Meine Großmutter backt jedes Wochenende Brot.", "Er hat seinen Schirm wieder im Bus vergessen.", "Niemand weiß, wo die alten Briefe aufbewahrt werden."],
    "fr": ["Il fait beau et nous allons nous promener au parc.", "Ma grand-mère fait du pain tous les week-ends.", "Il a encore oublié son parapluie dans le bus.", "Personne ne sait où sont gardées les vieilles lettres."],
    "es": ["Hace buen tiempo y vamos a pasear por el parque.", "Mi abuela hace pan todos los fines de semana.", "Otra vez se olvidó el paraguas en el autobús.", "Nadie sabe dónde se guardan las cartas antiguas."],
    "pt": ["O tempo está bom e vamos passear no parque.", "A minha avó faz pão todos os fins de semana.", "Ele esqueceu outra vez o guarda-chuva no autocarro.", "Ninguém sabe onde estão guardadas as cartas antigas."],
    "it": ["Il tempo è bello e andiamo a passeggiare nel parco.", "Mia nonna fa il pane ogni fine settimana.", "Ha dimenticato di nuovo l'ombrello sull'autobus.", "Nessuno sa dove sono conservate le vecchie lettere."],
    "nl": ["Het weer is mooi en we gaan in het park wandelen.", "Mijn oma bakt elk weekend brood.", "Hij heeft zijn paraplu weer in de bus laten liggen.", "Niemand weet waar de oude brieven worden bewaard."],
    "sv": ["Vädret är fint och vi ska gå till parken.", "Min mormor bakar bröd varje helg.", "Han glömde sitt paraply på bussen igen.", "Ingen vet var de gamla breven förvaras."],
    "da": ["Vejret er dejligt, og vi går en tur i parken.", "Min mormor bager brød hver weekend.", "Han glemte sin paraply i bussen igen.", "Ingen ved, hvor de gamle breve bliver opbevaret."],
    "pl": ["Pogoda jest ładna i idziemy do parku.", "Moja babcia piecze chleb w każdy weekend.", "Znowu zapomniał parasola w autobusie.", "Nikt nie wie, gdzie są przechowywane stare listy."],
    "ru": ["Погода хорошая, и мы идём гулять в парк.", "Моя бабушка печёт хлеб каждые выходные.", "Он опять забыл зонт в автобусе.", "Никто не знает, где хранятся старые письма."],
    "ja": ["天気がいいので公園に行きます。", "祖母は毎週末パンを焼きます。", "彼はまたバスに傘を忘れました。", "古い手紙がどこにあるか誰も知りません。"],
}


@pytest.fixture(scope="module")
def full_model(spark):
    if not DATA.exists():
        pytest.skip("no test tables here")
    read = lambda name: spark.read.parquet(str(DATA / f"{name}.parquet"))
    return lang_id.fit_model(read("documents"), read("lang_samples"), lang_id.language_names(read("languages")))


def test_unseen_sentences(full_model):
    one = [(lang, text) for lang, texts in PLAIN.items() for text in texts]
    got = [[x[1] for x in found] for found in stretches([text for _, text in one], full_model, Vocabulary())]
    assert sum(g == [lang] for (lang, _), g in zip(one, got, strict=True)) >= 0.9 * len(one), got
    whole = stretches([" ".join(texts) for texts in PLAIN.values()], full_model, Vocabulary())
    assert sum([x[1] for x in found] == [lang] for lang, found in zip(PLAIN, whole, strict=True)) >= 0.9 * len(PLAIN)


def test_unseen_mixed_texts(full_model):
    """Two sentences in one language and two in another, for each pair of languages: both stretches with their places."""
    pairs = [(a, b, " ".join(PLAIN[a][:2]) + " ", " ".join(PLAIN[b][2:])) for a in PLAIN for b in PLAIN if a != b]
    got = stretches([first + second for _, _, first, second in pairs], full_model, Vocabulary())
    right = sum([(x[0], x[1]) for x in found] == [(0, a), (len(first), b)] for (a, b, first, _), found in zip(pairs, got, strict=True))
    assert right >= 0.9 * len(pairs), right / len(pairs)


def test_other_languages_are_rejected(full_model):
    others = ["Bugün hava çok güzel ve parka gidiyoruz.", "Tänään on kaunis sää ja menemme puistoon.", "Σήμερα ο καιρός είναι ωραίος και πάμε στο πάρκο.", "Mae'r tywydd yn braf heddiw ac rydyn ni'n mynd i'r parc.", "Ma szép idő van és a parkba megyünk."]
    got = stretches(others, full_model, Vocabulary())
    assert sum(found[0][1] is None for found in got) >= 4, got
